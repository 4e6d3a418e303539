"""Stored plans: NDJSON entries, a header, and outcomes told since, versioned so that readers never see half a plan.

A run tells outcomes while it copies. They are appended as small tables of
their own (each batch writes only its rows) and merged when the plan is read;
``compact_plan`` turns them into a version, which notes how far it has got.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.plans.edit import apply_outcomes
from stowage.schemas import ENTRY_FIELDS, ENTRY_JSON, PLAN_HEADER
from stowage.sources import versions
from stowage.sources.inventory import _exists, read_ndjson
from stowage.sources.versions import StaleVersion, Version

# JSON name of an entry's place in the plan.
POSITION = "position"


def to_json_names(entries: DataFrame) -> DataFrame:
    place = [F.col("ord").alias(POSITION)] if "ord" in entries.columns else []
    return entries.select(
        *[F.col(ours).alias(theirs) for ours, theirs, _ in ENTRY_FIELDS if ours in entries.columns], *place)


def from_json_names(rows: DataFrame) -> DataFrame:
    place = [F.coalesce(POSITION, "ord.line").alias("ord")] if POSITION in rows.columns else []
    return rows.select(*[F.col(theirs).alias(ours) for ours, theirs, _ in ENTRY_FIELDS], *place)


def placed(entries: DataFrame) -> DataFrame:
    """Entries with ``ord``, their place in the plan, as a long.

    Places that are there stay; entries without one (new ones) come behind the
    last in the order in which they stand. Places increase but have gaps.
    """
    if "ord" not in entries.columns:
        return entries.withColumn("ord", F.monotonically_increasing_id())
    last = entries.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    return entries.withColumn("_line", F.monotonically_increasing_id()).withColumn(
        "ord", F.coalesce("ord", F.lit(last + 1) + F.col("_line"))).drop("_line")


def write_placed(entries: DataFrame, path: str) -> None:
    """Write entries with their places, as ``placed`` gives them, without reading a plan for its last place first.

    Entries that have a place are written, and the last place is seen on the way; those without one are made and
    written behind them, if there are any.
    """
    if "ord" not in entries.columns:
        return write_entries(placed(entries), path)
    seen = Observation()
    known = entries.observe(seen, F.max("ord").alias("last"), F.count_if(F.col("ord").isNull()).alias("new"))
    write_entries(known.filter("ord is not null"), path)
    if seen.get["new"]:
        last = -1 if seen.get["last"] is None else seen.get["last"]
        line = entries.withColumn("_line", F.monotonically_increasing_id()).filter("ord is null")
        write_entries(line.withColumn("ord", F.lit(last + 1) + F.col("_line")).drop("_line"), path, "append")


def read_entries(spark: SparkSession, path) -> DataFrame:
    """Entries of a plan with their place in it; lines that are not JSON are dropped.

    A file that holds no places gives those of its lines.
    """
    return from_json_names(read_ndjson(spark, path, T.StructType([*ENTRY_JSON.fields, T.StructField(POSITION, T.LongType())])))


def write_entries(entries: DataFrame, path: str, mode: str = "error") -> None:
    """Write entries as NDJSON in gzip; null fields are left out. ``append`` adds to a plan.

    Every version of a plan stays on disk, and names repeat in every line. A
    file is read by one task, and is as long as the partition it was written from.
    """
    to_json_names(entries).write.mode(mode).json(path, compression="gzip")


def write_header(spark: SparkSession, header: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_header(spark: SparkSession, path: str) -> dict | None:
    if not _exists(spark, path):
        return None
    row = spark.read.text(path, wholetext=True).filter("try_parse_json(value) is not null").first()
    return json.loads(row.value) if row else None


class StalePlan(StaleVersion):
    """Another version of the plan was stored since the one that was edited."""


@dataclass(frozen=True)
class StoredPlan:
    """One version with the outcomes told until it was read; ``told`` has the last batch of each stream."""

    version: Version
    entries: DataFrame
    told: dict[str, int]

    @property
    def header(self) -> dict:
        return self.version.content["header"]


def write_plan(
    spark: SparkSession, entries: DataFrame, header: dict, folder: str, base: str | StoredPlan | None = None,
) -> str:
    """Store a new version of a plan and return its name.

    The order of entries is stored with them. ``base`` is the version that
    ``entries`` were made from: if the plan has moved on, or another writer
    commits first, ``StalePlan`` is raised; of two writers on one base one
    wins. Without a base the plan is replaced, whoever wrote before. The
    version holds all outcomes told until ``base`` was read (a ``StoredPlan``)
    or until now; later ones go on top.
    """
    name = uuid.uuid4().hex
    table = versions.new_table(folder, "entries")
    last = versions.latest(spark, folder)
    wanted = base.version.content["name"] if isinstance(base, StoredPlan) else base
    if wanted is not None and (last is None or last.content["name"] != wanted):
        raise StalePlan(f"{folder} is no longer at {wanted}")
    told = base.told if isinstance(base, StoredPlan) else _last_batches(_told(spark, folder))
    write_placed(entries, table)
    content = {"name": name, "entries": table[len(folder) + 1:], "header": header, "told": told}
    while True:
        try:
            versions.commit(spark, folder, last, content)
            return name
        except StaleVersion as error:
            if base is not None:
                raise StalePlan(str(error)) from None
            last = versions.latest(spark, folder)


def current_version(spark: SparkSession, folder: str) -> str | None:
    last = versions.latest(spark, folder)
    return last.content["name"] if last else None


def load_plan(spark: SparkSession, folder: str) -> StoredPlan:
    """The newest version with the outcomes told since."""
    last = versions.latest(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no plan in {folder}")
    entries = read_entries(spark, f"{folder}/{last.content['entries']}")
    done = last.content["told"]
    batches = [b for b in _told(spark, folder) if b["batch"] > done.get(b["stream"], -1)]
    if batches:
        # Tables, not rows: one for each batch since the last compaction.
        outcomes = spark.read.parquet(*[f"{folder}/{b['table']}" for b in batches])
        entries = apply_outcomes(entries, outcomes, ["_order", "_batch"])
    return StoredPlan(last, entries, done | _last_batches(batches))


def read_plan(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    plan = load_plan(spark, folder)
    return plan.entries, plan.header


def _told(spark: SparkSession, folder: str) -> list[dict]:
    if not _exists(spark, f"{folder}/told"):
        return []
    rows = spark.read.schema("stream string, batch long, table string").json(f"{folder}/told").collect()
    return [row.asDict() for row in rows]


def _last_batches(batches: list[dict]) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in batches:
        out[b["stream"]] = max(b["batch"], out.get(b["stream"], -1))
    return out


def tell_outcomes(
    spark: SparkSession, folder: str, outcomes: DataFrame, order: list[str], batch: int, stream: str = "run",
) -> bool:
    """Append outcomes to a plan; False if this batch of the stream was told before.

    ``order`` columns say which report of a file is the last, over all batches;
    of equals the later batch counts. All outcomes of a plan have the same
    columns.
    """
    mark = f"{folder}/told/{stream}-{batch:020d}.json"
    if _exists(spark, mark):
        return False
    table = versions.new_table(folder, f"told-{stream}-{batch}")
    keys = [c for c in ("drive_name", "src_path", "status", "error", "at") if c in outcomes.columns]
    outcomes.select(*keys, F.struct(*order).alias("_order"), F.lit(batch).cast("long").alias("_batch")).write.parquet(table)
    return versions.create_if_absent(
        spark, mark, json.dumps({"stream": stream, "batch": batch, "table": table[len(folder) + 1:]}))


def compact_plan(spark: SparkSession, folder: str) -> str | None:
    """Make a version of the outcomes told since the last one; None if there are none.

    Outcomes told meanwhile stay on top of it, and an edit meanwhile makes it stale.
    """
    plan = load_plan(spark, folder)
    if plan.told == plan.version.content["told"]:
        return None
    return write_plan(spark, plan.entries, plan.header, folder, plan)


def preview(entries: DataFrame, limit: int | None = None, order: str = "ord") -> DataFrame:
    """First entries in plan order; zero or no limit gives them all, in order."""
    ordered = entries.orderBy(order)
    return ordered.limit(limit) if limit else ordered


def parse_headers(texts: DataFrame) -> DataFrame:
    """Headers from a ``value`` column; a document that cannot be parsed gives a null header."""
    parsed = F.when(F.expr("try_parse_json(value) is not null"), F.from_json("value", PLAN_HEADER))
    return texts.withColumn("header", parsed).drop("value")
