"""Helpers shared by the operators: shared-folder tables, ranges, and the task count."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.session import materialize

_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def reachable(query: Callable) -> Callable:
    """Let Python workers import this package also where it is not installed but run from its folder."""
    @wraps(query)
    def run(spark: SparkSession, *rest):
        given = spark.sparkContext.environment
        path = given.get("PYTHONPATH", "")
        if _HOME not in path.split(os.pathsep):
            given["PYTHONPATH"] = os.pathsep.join(filter(None, [path, _HOME]))
        return query(spark, *rest)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sizes(text: Column) -> Column:
    """Number of words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_share(*key: Column) -> Column:
    """A number from 0 to 1 that grows with the hash of ``key``."""
    return (F.shiftright(F.xxhash64(*key), 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))


def enough_of(wanted: int, total: int) -> float:
    """Share of ``total`` hashed rows that holds ``wanted`` of them, but for one time in a thousand million."""
    return min(1.0, (wanted + 8 * math.sqrt(wanted) + 32) / max(total, 1))


def drawn(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """At most ``n`` rows: those with the smallest seeded hash of ``key``.

    The hash is cut near the border first, by the number of rows, so that not
    every task hands on ``n`` rows. ``rows`` should be a stored table.
    """
    hashed = (F.lit(seed), F.col(key))
    few = materialize(rows.filter(draw_share(*hashed) <= enough_of(n, rows.count())), "drawn")
    return few.orderBy(F.xxhash64(*hashed), key).limit(n)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 in ``order``, without gaps.

    Rows are dealt by range of (keys, order), so that a group of any size is
    shared between tasks. Each range counts its own rows; the counts of the
    ranges before it are added. Those counts are one row per key and range.
    ``order`` should tell rows apart, or many equal ones share a range.
    """
    # Stored, as the border of the ranges must not move between the two uses.
    cut = materialize(
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("_range", F.spark_partition_id()),
        "ranges")
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = cut.withColumn("_own", F.row_number().over(inside) - 1)
    on = own["_range"] == counts["_r"]
    for i, k in enumerate(keys):
        on = on & own[k].eqNullSafe(counts[f"_k{i}"])
    return own.join(counts, on).select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))
