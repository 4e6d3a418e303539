"""Grouping and joining when one key may hold a large part of all rows.

The plan is the same at every size. A group's totals are aggregates that map
tasks combine, so no key is hot there: the shuffle carries one row per key and
task. They are joined back on the key, and an oversized part of the large side
is split while the query runs (adaptive skew joins), as the other side has one
row per key. Nothing is counted or collected beforehand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.session import materialize


def join_keys(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match; the keys come from ``big``."""
    renamed = small.select(*[F.col(k).alias(f"_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [big[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return big.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def with_group(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of each row's group to the row. ``df`` is read twice."""
    return join_keys(df, df.groupBy(*keys).agg(*[total.alias(name) for name, total in totals.items()]), keys)


def pick_first(df: DataFrame, keys: list[str], order: list[Column], carry: dict[str, Column | int]) -> DataFrame:
    """Mark the first row of each group and give every row the winner's ``carry`` values.

    Adds ``is_winner`` and one column per ``carry`` item; a number stands for
    that column of ``order``, which is then not shuffled a second time.
    ``order`` must tell the rows of one group apart. ``df`` is read twice.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min(F.struct(
        rank.alias("_rank"), *[value.alias(name) for name, value in carry.items() if not isinstance(value, int)],
    )).alias("_best"))
    told = [F.col(f"_best._rank.o{value}" if isinstance(value, int) else f"_best.{name}").alias(name)
            for name, value in carry.items()]
    return join_keys(df, best, keys).select(*df.columns, (rank == F.col("_best._rank")).alias("is_winner"), *told)


def running_count(df: DataFrame, key: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """Add how many rows of the same key up to this one (in ``order``) satisfy ``flag``.

    Rows are dealt by range of (key, order), so that one key may fill many
    tasks: ranges are counted apart, and the totals of the ranges before are
    added. Those totals are one row per key and range.
    """
    one = F.when(flag, 1).otherwise(0)
    # Stored, so that the number of a range cannot change between its two uses.
    cut = materialize(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(key, "_range").agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = join_keys(cut.withColumn("_own", F.sum(one).over(inside)), totals, [key, "_range"])
    return counted.withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


# Places in one range of ``place_among``, as a power of two: a key's rows of a range are sorted by one task.
RANGE_BITS = 16


def place_among(df: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """Add each row's number (from 1) among the rows of its key, by ``place``.

    ``place`` is a stored long that tells the rows of a key apart and is not
    null. Ranges of places have a fixed width, so none holds more rows of a
    key than that and they are the same whenever ``df`` is read: rows are
    shuffled once, by key and range, and numbered there; behind them come the
    totals of the ranges before, one row per key and range. ``df`` is read
    twice.
    """
    # A struct, in which null keys are equal, so that windows and join ask for the same partitions.
    part = F.struct(F.col(key).alias("key"), F.shiftright(place, RANGE_BITS).alias("range")).alias("_part")
    totals = df.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_part.key").orderBy("_part.range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(place)
    rest = [c for c in df.columns if c != key]
    own = df.select(part, *rest).withColumn("_own", F.row_number().over(inside))
    counted = own.join(totals, "_part").withColumn(name, F.col("_before") + F.col("_own"))
    return counted.select(*[F.col("_part.key").alias(key) if c == key else F.col(c) for c in df.columns], name)
