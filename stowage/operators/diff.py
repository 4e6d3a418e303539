"""What changed between two scans of one drive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.operators.skew import running_count
from stowage.session import materialize

# A file that moves keeps these.
MOVE_KEY = ("size", "name", "ext", "mtime")
_FACTS = ("size", "mtime")


def _first_of_path(scan: DataFrame, order: str) -> DataFrame:
    # The rank filter works in map tasks first, and the scan is shuffled once: the join asks for the same partitions, as
    # null paths are equal in a struct.
    keyed = scan.select(F.struct("path").alias("at"), *MOVE_KEY, F.col(order).alias("_order"))
    rank = F.rank().over(Window.partitionBy("at").orderBy("_order"))
    return keyed.withColumn("_rank", rank).filter("_rank = 1").select("at", *MOVE_KEY)


def _paired(lost: DataFrame, found: DataFrame) -> DataFrame:
    """``old_path, path``: the n-th lost file of a key with the n-th found one, in path order.

    A key may be that of very many files (say, all empty ones), so both sides
    are numbered over ranges and joined on key and number.
    """
    def numbered(side: DataFrame, name: str) -> DataFrame:
        key = F.to_json(F.struct(*MOVE_KEY), {"ignoreNullFields": "false"})
        rows = side.select(key.alias("_key"), "path")
        return running_count(rows, "_key", ["path"], F.lit(True), "_n").withColumnRenamed("path", name)

    return numbered(lost, "old_path").join(numbered(found, "path"), ["_key", "_n"]).select("old_path", "path")


def scan_diff(before: DataFrame, after: DataFrame, order: str = "ord", moves: bool = True) -> DataFrame:
    """One row per difference: ``change, path, old_path, old_size, size, old_mtime, mtime``.

    ``change`` is ``added``, ``removed``, ``changed`` (the same path with
    another size or time) or ``moved`` (another path with the same size, name,
    extension and time; of several such files the first by path are paired).
    Files that stayed as they were are left out; ``moves=False`` leaves moved
    files as removed and added. If a scan lists a path twice, the first by
    ``order`` counts. Null paths match each other, null sizes and times too.
    """
    old, new = _first_of_path(before, order).alias("o"), _first_of_path(after, order).alias("n")
    both = old.join(new, F.col("o.at") == F.col("n.at"), "full")
    same: Column = F.lit(True)
    for fact in _FACTS:
        same = same & F.col(f"o.{fact}").eqNullSafe(F.col(f"n.{fact}"))
    # The struct tells presence, as a path may be null.
    change = F.when(F.col("o.at").isNull(), "added").when(F.col("n.at").isNull(), "removed").when(~same, "changed")
    rows = both.select(
        change.alias("change"), F.coalesce("n.at", "o.at")["path"].alias("path"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("name", "ext")],
        *[F.col(f"{side}.{fact}").alias(f"{prefix}{fact}") for fact in _FACTS for side, prefix in (("o", "old_"), ("n", ""))])
    rows = rows.filter("change is not null").withColumn("old_path", F.when(F.col("change") == "changed", F.col("path")))
    out = ["change", "path", "old_path", "old_size", "size", "old_mtime", "mtime"]
    if not moves:
        return rows.withColumn("old_path", F.when(F.col("change") == "removed", F.col("path")).otherwise(
            F.col("old_path"))).select(out)
    # Stored, as pairs and the result are made of it: only what differs.
    rows = materialize(rows, "changes")
    lost = rows.filter("change = 'removed'").select("path", "name", "ext", F.col("old_size").alias("size"), F.col("old_mtime").alias("mtime"))
    found = rows.filter("change = 'added'").select("path", *MOVE_KEY)
    pairs = _paired(lost, found)
    left = pairs.select(F.col("old_path").alias("_path"), F.lit(True).alias("_gone"))
    to = pairs.select(F.col("path").alias("_path"), F.col("old_path").alias("_from"))
    removed = rows.filter("change = 'removed'").join(left, F.col("path").eqNullSafe(F.col("_path")), "left").filter(
        "_gone is null").withColumn("old_path", F.col("path"))
    # A moved file keeps size and time, so those before are those after.
    added = rows.filter("change = 'added'").join(
        to.withColumn("_moved", F.lit(True)), F.col("path").eqNullSafe(F.col("_path")), "left")
    added = added.withColumns({
        "change": F.when(F.col("_moved"), "moved").otherwise("added"), "old_path": F.col("_from"),
        "old_size": F.when(F.col("_moved"), F.col("size")), "old_mtime": F.when(F.col("_moved"), F.col("mtime"))})
    return rows.filter("change = 'changed'").select(out).unionByName(removed.select(out)).unionByName(added.select(out))


def diff_totals(diff: DataFrame) -> DataFrame:
    """Files and bytes by kind of change; bytes are those after it, of removed files those before."""
    bytes_ = F.coalesce(F.sum(F.when(F.col("change") == "removed", F.col("old_size")).otherwise(F.col("size"))), F.lit(0))
    return diff.groupBy("change").agg(F.count("*").alias("files"), bytes_.cast("long").alias("bytes"))
