"""Build a copy plan: projects first, loose files second, every file accounted for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import (
    base_name, dupe_key, file_ext, flat_dst, joined_dst, one_separator, repeats_separator, utf16_length,
)
from stowage.operators.dedup import ORDER, TIE_BREAKS, dedupe_files
from stowage.operators.projects import (
    detect_projects, first_seen, folder_projects, own_folders, signature_items, split_files,
)
from stowage.operators.reports import plan_totals, rule_stats
from stowage.operators.rules import ProjectSettings
from stowage.operators.similarity import similar_groups
from stowage.operators.skew import pick_first
from stowage.schemas import ENTRY
from stowage.session import materialize
from stowage.sources.inventory import ScanSource

LAYOUTS = ("mirrored", "flat")
DEST_MODES = ("additive", "overwrite", "fresh")


@dataclass(frozen=True)
class PlanOptions:
    destination: str = ""
    layout: str = "mirrored"
    tie_break: str = "firstScanned"
    dest_mode: str = "additive"
    projects: ProjectSettings = field(default_factory=ProjectSettings)
    blocking: bool = True
    order: tuple[str, ...] = ORDER

    def __post_init__(self):
        for value, allowed in ((self.layout, LAYOUTS), (self.tie_break, TIE_BREAKS), (self.dest_mode, DEST_MODES)):
            if value not in allowed:
                raise ValueError(f"{value!r} is not one of {allowed}")


@dataclass(frozen=True)
class Plan:
    """A plan in the making: its entries, its projects, and a header made on demand."""

    entries: DataFrame
    projects: DataFrame | None
    options: PlanOptions
    sources: list[ScanSource]

    def header(self, plan_id: str, created: datetime | None = None) -> dict:
        totals = self.entries.transform(plan_totals).first()
        grouped = {"enabled": False}
        if self.projects is not None:
            by_rule = {r.rule_name: {"kept": r.kept, "collapsed": r.collapsed}
                       for r in rule_stats(self.projects).collect()}  # one row per rule
            grouped = {
                "enabled": True, "similarityThreshold": self.options.projects.threshold,
                "projectsKept": sum(r["kept"] for r in by_rule.values()),
                "projectsCollapsed": sum(r["collapsed"] for r in by_rule.values()), "byRule": by_rule,
            }
        return {
            "id": plan_id,
            "createdAt": (created or datetime.now(timezone.utc)).isoformat(),
            "sources": [{"scan": s.scan, "ndjson": s.ndjson, "volumeUUID": s.volume_uuid,
                         "driveName": s.drive_name, "root": s.root} for s in self.sources],
            "destination": self.options.destination, "layout": self.options.layout, "dedup": "fast",
            "tieBreak": self.options.tie_break, "destMode": self.options.dest_mode, "projectDedup": grouped,
            "totalFiles": totals.total_files, "totalBytes": totals.total_bytes,
            "duplicatesCollapsed": totals.duplicates_collapsed,
            "projectDuplicatesCollapsed": totals.project_duplicates_collapsed,
            "errorCount": totals.error_count, "entriesFile": f"{plan_id}.entries.ndjson", "status": "ready",
        }


def project_order(tie_break: str) -> list[Column]:
    """Ascending sort values that put the project to keep first; ties go to the one seen first.

    ``newest`` and ``oldest`` compare files plus bytes: a project has no date.
    """
    weight = F.col("file_count") + F.col("total_bytes")
    metric = {
        "newest": [-weight],
        "oldest": [weight],
        "shortestPath": [utf16_length("folder"), F.collate("folder", "UNICODE")],
        "largest": [-F.col("total_bytes")],
    }.get(tie_break, [])
    return metric + [F.col("scan_order"), F.col("first_ord"), F.col("depth"), F.col("folder")]


def choose_projects(
    projects: DataFrame, groups: DataFrame, tie_break: str,
) -> DataFrame:
    """Mark the project to keep in each group and tell the others which one that is."""
    grouped = projects.join(groups, "project_key")
    return pick_first(grouped, ["component"], project_order(tie_break), {
        "winner_root": F.col("folder"), "winner_drive": F.col("drive_name"), "winner_rule": F.col("rule_name"),
    })


def shape_entries(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the entry columns; those not given are null."""
    return df.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields
    ])


def _placed(files: DataFrame, keep: Column, layout: str, name: Column) -> DataFrame:
    """``files`` with ``_dst``, the destination of those to keep.

    A column of its own, so that it is made once, and searched by a regex only where it has to be.
    """
    if layout == "flat":
        return files.withColumn("_dst", F.when(keep, name))
    joined = files.withColumn("_dst", F.when(keep, joined_dst("drive_name", "path", "root")))
    return joined.withColumn("_dst", F.when(repeats_separator("_dst"), one_separator("_dst")).otherwise(F.col("_dst")))


def _uuid(df: DataFrame) -> Column:
    return F.col("volume_uuid") if "volume_uuid" in df.columns else F.lit(None)


def project_entries(
    tagged: DataFrame, chosen: DataFrame, layout: str,
) -> DataFrame:
    """Entries of all files inside projects: copied with the kept ones, skipped with the others."""
    facts = chosen.select("project_key", "project_id", F.col("folder").alias("p_root"), "rule_name", "is_winner",
                          "winner_root", "winner_drive")
    keep, lose = F.col("is_winner"), ~F.col("is_winner")
    files = _placed(tagged.join(facts, "project_key"), keep, layout, flat_dst("path"))
    return shape_entries(
        files,
        src_path=F.col("path"), volume_uuid=_uuid(files), drive_name=F.col("drive_name"),
        dst_rel_path=F.col("_dst"),
        size=F.coalesce("size", F.lit(0)), mtime=F.lit(0), ext=file_ext(base_name("path")),
        dupe_key=F.concat(F.lit("project::"), F.col("project_id")),
        status=F.when(keep, F.lit("pending")).otherwise(F.lit("skipped-project-duplicate")),
        project_root=F.col("p_root"), project_rule=F.col("rule_name"),
        winner_project_root=F.when(lose, F.col("winner_root")), winner_drive=F.when(lose, F.col("winner_drive")),
    )


def file_entries(
    loose: DataFrame, tie_break: str, layout: str, order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """Entries of files outside projects: one copy of each stays, the others name it."""
    keep = F.col("is_winner")
    marked = _placed(dedupe_files(loose, tie_break, order), keep, layout, F.col("name"))
    return shape_entries(
        marked,
        src_path=F.col("path"), volume_uuid=_uuid(marked), drive_name=F.col("drive_name"),
        dst_rel_path=F.col("_dst"),
        size=F.col("size"), mtime=F.col("mtime"), ext=F.col("ext"), dupe_key=dupe_key(),
        status=F.when(keep, F.lit("pending")).otherwise(F.lit("skipped-duplicate")),
        winner_path=F.when(~keep, F.col("winner_path")),
    )


def error_entries(errors: DataFrame) -> DataFrame:
    """Entries for the paths a scan could not read."""
    return shape_entries(
        errors, src_path=F.col("path"), volume_uuid=_uuid(errors), drive_name=F.col("drive_name"),
        error=F.col("error"), status=F.lit("source-error"))


def roots_overlap(sources: list[ScanSource]) -> bool:
    """True when a path could belong to two of the scans."""
    roots = sorted(s.root.rstrip("/") + "/" for s in sources)
    return any(b.startswith(a) for a, b in zip(roots, roots[1:]))


def build_plan(
    files: DataFrame, options: PlanOptions = PlanOptions(), sources: list[ScanSource] | None = None,
    errors: DataFrame | None = None,
) -> Plan:
    """Plan the copy of all ``files`` to one destination.

    ``files`` is a scan union with a fixed ``ord``. It is read twice: for its
    folders, and to store the files apart by whether a project holds them.
    Without ``sources`` whose roots do not overlap, a path that a project of
    another scan claims is looked for and excluded as well.
    """
    settings = options.projects
    chosen = None
    loose, parts = files, []
    if settings.enabled:
        seen = options.order[-1]
        own = materialize(own_folders(files, settings.rules, seen, everywhere=False, exact=False), "folders")
        projects = materialize(detect_projects(own, settings), "projects")
        holders = materialize(folder_projects(own, projects), "holders")
        # A path that a project of another scan claims can only be listed where roots overlap.
        claims = sources is None or roots_overlap(sources)
        unused = tuple({"name", "mtime", "ext"} - {seen})
        tagged, loose = split_files(files, holders, seen, claims, unused)
        projects = first_seen(projects, tagged, seen)
        items = signature_items(tagged, settings.opaque, count_repeats=False)
        groups = similar_groups(projects, items, settings.effective_threshold, options.blocking)
        chosen = materialize(choose_projects(projects, groups, options.tie_break), "chosen")
        parts.append(project_entries(tagged, chosen, options.layout))
    parts.insert(0, file_entries(loose, options.tie_break, options.layout, options.order))
    if errors is not None:
        parts.append(error_entries(errors))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return Plan(entries, chosen, options, sources or [])


def _told_again() -> tuple[Column, Column]:
    """The duplicate key and the destination as they follow from the other columns of ``slim`` entries."""
    return (dupe_key("size", F.substring_index("src_path", "/", -1), "ext"),
            F.concat("drive_name", F.substr("src_path", F.col("_dst_from"))))


def slim(entries: DataFrame) -> DataFrame:
    """Entries without the texts that their paths tell again, to be shuffled; ``full`` gives them back.

    Any other text stays as it is. Entries that lack a column they need are left as they are.
    """
    if not {"src_path", "drive_name", "dst_rel_path", "size", "ext", "dupe_key"} <= set(entries.columns):
        return entries
    key, dst = _told_again()
    start = F.length("src_path") - F.length("dst_rel_path") + F.length("drive_name") + 1
    same_key = F.coalesce(F.col("dupe_key") == key, F.lit(False))
    same_dst = F.coalesce((F.col("_dst_from") >= 1) & (F.col("dst_rel_path") == dst), F.lit(False))
    return entries.withColumns({"_dst_from": start, "_own_key": same_key}).withColumns({
        "dupe_key": F.when(~F.col("_own_key"), F.col("dupe_key")),
        "dst_rel_path": F.when(~same_dst, F.col("dst_rel_path")), "_dst_from": F.when(same_dst, F.col("_dst_from")),
    })


def full(entries: DataFrame) -> DataFrame:
    """Entries as they were before ``slim``."""
    if "_dst_from" not in entries.columns:
        return entries
    key, dst = _told_again()
    return entries.withColumns({
        "dupe_key": F.when(F.col("_own_key"), key).otherwise(F.col("dupe_key")),
        "dst_rel_path": F.coalesce("dst_rel_path", dst),
    }).drop("_dst_from", "_own_key")


def kept(entries: DataFrame) -> DataFrame:
    """Entries stored as a table without the texts that their paths tell again, for a plan that is read more than once."""
    return full(materialize(slim(entries), "entries"))


def in_order(entries: DataFrame, *order) -> DataFrame:
    """Entries sorted by ``order``, which must not name their destination or duplicate key.

    They are stored first, as a sort by range reads them twice.
    """
    return full(materialize(slim(entries), "entries").orderBy(*order))


def in_copy_order(entries: DataFrame) -> DataFrame:
    """Entries by drive and path, so that a copier works through one drive after another."""
    return in_order(
        entries, F.expr("collate(coalesce(drive_name, ''), 'UNICODE')"), F.expr("collate(coalesce(src_path, ''), 'UNICODE')"))


def with_position(ordered: DataFrame) -> DataFrame:
    """Number the rows of a sorted plan; later positions have larger numbers."""
    return ordered.withColumn("ord", F.monotonically_increasing_id())
