"""How many duplicates drives share with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.dedup import KEY


def drive_sets(files: DataFrame, drive: str = "drive_name") -> DataFrame:
    """``drives, shared_keys, shared_bytes`` by the set of drives that hold a copy of the same file.

    Files are reduced to one row per key and drive, then to one per key; a
    set is never larger than the number of drives. Copies within one drive
    count once. Files without a drive are one drive with a null name.
    """
    held = files.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "ext" else c for c in KEY], drive).distinct()
    # An array keeps no null, so a name is wrapped.
    sets = held.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(F.col(drive).alias("drive")))).alias("drives"))
    sets = sets.filter(F.size("drives") > 1)
    return sets.groupBy("drives").agg(
        F.count("*").alias("shared_keys"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("shared_bytes"))


def drive_pairs(files: DataFrame, drive: str = "drive_name") -> DataFrame:
    """``drive_a, drive_b, shared_keys, shared_bytes``: files of which both drives hold a copy, each counted once.

    Pairs are made of distinct sets of drives, not of files or keys.
    """
    sets = drive_sets(files, drive).select("*", F.posexplode("drives").alias("at", "a"))
    pairs = sets.select("shared_keys", "shared_bytes", "a", F.explode(
        F.expr("slice(drives, at + 2, size(drives))")).alias("b"))
    return pairs.groupBy(F.col("a.drive").alias("drive_a"), F.col("b.drive").alias("drive_b")).agg(
        F.sum("shared_keys").alias("shared_keys"), F.sum("shared_bytes").alias("shared_bytes"))
