"""Change a plan: add, remove, clear, reset, save under a new name, apply outcomes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import base_name
from stowage.operators.dedup import TIE_BREAKS, first_in_batch
from stowage.operators.reports import recompute_totals
from stowage.plans.build import DEST_MODES, LAYOUTS, full, shape_entries, slim
from stowage.schemas import ENTRY, STATUSES

# The statuses a reset turns back to pending.
RESETTABLE = ("copied", "failed", "skipped-exists", "skipped-volume-unavailable", "source-missing")
KEPT_ON_SAVE = ("skipped-duplicate", "source-error")


def working_plan(spark) -> tuple[DataFrame, dict]:
    """The empty default plan: entries and header."""
    header = {
        "id": "working", "kind": "working", "name": "Working plan",
        "createdAt": datetime.now(timezone.utc).isoformat(), "sources": [], "destination": "",
        "layout": "mirrored", "dedup": "fast", "tieBreak": "firstScanned", "destMode": "additive",
        "totalFiles": 0, "totalBytes": 0, "duplicatesCollapsed": 0, "errorCount": 0,
        "entriesFile": "working.entries.ndjson", "status": "ready",
    }
    return spark.createDataFrame([], ENTRY), header


def manual_entry(incoming: DataFrame) -> DataFrame:
    """Entries made of picked files, with defaults for what the picker does not know."""
    def text(name):
        return F.nullif(F.col(name), F.lit("")) if name in incoming.columns else F.lit(None)

    def number(name):
        return F.coalesce(F.col(name), F.lit(0)) if name in incoming.columns else F.lit(0)

    return shape_entries(
        incoming,
        src_path=F.col("src_path"), volume_uuid=text("volume_uuid"), drive_name=text("drive_name"),
        dst_rel_path=text("dst_rel_path"), size=number("size"), mtime=number("mtime"),
        ext=F.coalesce(text("ext"), F.lit("")), name=F.coalesce(text("name"), base_name("src_path")),
        dupe_key=F.concat(F.lit("manual::"), F.col("src_path")), status=F.lit("pending"),
    )


@dataclass(frozen=True)
class Added:
    entries: DataFrame
    new: DataFrame
    skipped: DataFrame

    def report(self) -> dict:
        added = self.new.count()
        return {"added": added, "skipped": self.skipped.count(),
                "total": recompute_totals(self.entries).first().total_files}


def plan_add(entries: DataFrame, incoming: DataFrame, order: list[str]) -> Added:
    """Append files that the plan does not hold yet; within the batch the first mention counts.

    Rows without a path are ignored and not counted as skipped.
    """
    named = incoming.filter("src_path is not null and src_path <> ''")
    first = first_in_batch(named, "src_path", order)
    new = first.join(entries.select("src_path"), "src_path", "left_anti")
    known = named.join(entries.select("src_path"), "src_path", "left_semi")
    repeated = named.groupBy("src_path").agg((F.count("*") - 1).alias("n")).filter("n > 0").join(
        entries.select("src_path"), "src_path", "left_anti")
    skipped = known.select("src_path").unionByName(
        repeated.select("src_path", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("src_path"))
    made = manual_entry(new)
    return Added(entries.unionByName(made, allowMissingColumns=True), made, skipped)


def plan_remove(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries without the given source paths. The report counts what was asked for, not what was there."""
    return entries.join(paths.select("src_path"), "src_path", "left_anti").select(entries.columns)


def plan_clear(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def plan_update_settings(header: dict, **changes) -> dict:
    """Header with changed settings; only text values count, and only allowed ones."""
    allowed = {"layout": LAYOUTS, "tieBreak": TIE_BREAKS, "destMode": DEST_MODES}
    out = dict(header)
    for key in ("destination", "layout", "tieBreak", "destMode", "name"):
        value = changes.pop(key, None)
        if not isinstance(value, str):
            continue
        if key in allowed and value not in allowed[key]:
            raise ValueError(f"{value!r} is not a {key}")
        out[key] = value
    if changes:
        raise TypeError(f"unknown settings: {sorted(changes)}")
    return out


def plan_reset(entries: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Turn finished entries back to pending, so that the plan can run again."""
    again = F.coalesce(F.col("status").isin(list(only or RESETTABLE)), F.lit(False))
    return entries.withColumns({
        "copied_at": F.when(~again, F.col("copied_at")), "error": F.when(~again, F.col("error")),
        "status": F.when(again, F.lit("pending")).otherwise(F.col("status")),
    })


def count_resettable(entries: DataFrame, only: list[str] | None = None) -> DataFrame:
    return entries.agg(F.count_if(F.col("status").isin(list(only or RESETTABLE))).alias("flipped"),
                       F.count("*").alias("total"))


def saved_name(name: str | None) -> str:
    return re.sub(r"[^a-z0-9_-]+", "_", name or "plan", flags=re.I)[:60] or "plan"


def plan_save_as(
    entries: DataFrame, header: dict, name: str | None, now_ms: int, keep_project_duplicates: bool = False,
) -> tuple[DataFrame, dict]:
    """Copy of a plan that starts fresh.

    Files of collapsed projects come back as pending, without a destination,
    unless ``keep_project_duplicates`` is set.
    """
    kept = list(KEPT_ON_SAVE) + (["skipped-project-duplicate"] if keep_project_duplicates else [])
    fresh = entries.withColumn(
        "status", F.when(F.col("status").isin(kept), F.col("status")).otherwise(F.lit("pending")))
    plan_id = f"plan_{saved_name(name)}_{now_ms}"
    totals = recompute_totals(fresh).first()
    copy = {
        **header, "id": plan_id, "kind": "saved", "name": name or plan_id,
        "createdAt": datetime.fromtimestamp(now_ms / 1000, timezone.utc).isoformat(),
        "entriesFile": f"{plan_id}.entries.ndjson", "totalFiles": totals.total_files,
        "totalBytes": totals.total_bytes, "duplicatesCollapsed": totals.duplicates_collapsed,
        "errorCount": totals.error_count,
    }
    return fresh, copy


def apply_outcomes(
    entries: DataFrame, outcomes: DataFrame, order: list[str] | None = None,
) -> DataFrame:
    """Entries with the status, error and copy time that a copier reports.

    Matched on drive and source path where outcomes name the drive, else on
    the path; picked and internal files have no drive, and null matches null.
    With ``order`` the last report of a file counts; without it a file may be
    reported once only, and a second report fails the query, as does a status
    that is not known. A drive with very many entries spreads, as the path is
    part of the key.
    """
    keys = ["drive_name", "src_path"] if "drive_name" in outcomes.columns else ["src_path"]
    status = F.when(F.col("status").isin(list(STATUSES)), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown outcome status: "), F.coalesce("status", F.lit("null")))))
    error = F.col("error") if "error" in outcomes.columns else F.lit(None).cast("string")
    at = F.col("at") if "at" in outcomes.columns else F.lit(None).cast("long")
    told = F.struct(status.alias("_status"), error.alias("_error"), at.alias("_at"))
    if order:
        report = F.max_by(told, F.struct(*order))
    else:
        report = F.when(F.count("*") == 1, F.first(told)).otherwise(
            F.raise_error(F.lit("a file is reported twice; give the order of reports")))
    # A struct, in which nulls are equal: reports are grouped and joined in the same partitions.
    kinds = {k: entries.schema[k].dataType for k in keys}
    key = F.struct(*[F.col(k).cast(kind).alias(k) for k, kind in kinds.items()]).alias("_key")
    small = outcomes.groupBy(key).agg(report.alias("_o")).select("_key", "_o.*")
    thin = slim(entries)
    joined = full(thin.select(key, *[c for c in thin.columns if c not in keys]).join(small, "_key", "left").select(
        "_key.*", *[c for c in thin.columns if c not in keys], "_status", "_error", "_at"))
    told = F.col("_status").isNotNull()
    return joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "error": F.when(told, F.col("_error")).otherwise(F.col("error")),
        "copied_at": F.when(told, F.when(F.col("_status") == "copied", F.col("_at"))).otherwise(F.col("copied_at")),
    }).select(entries.columns)
