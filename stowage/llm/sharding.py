"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key jumps from shard to shard as their number grows, and stays at the last
jump inside the number asked for; there is no ring and no table. One more shard
takes an even part of the rows, and none moves between the old ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tables import documents, numbered
from stowage.session import materialize

SHARDS = 8
# Fixed value: the multiplier of the published generator.
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (taken as an unsigned 64-bit number)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        key[moving] = key[moving] * _STEP + np.uint64(1)
        reach = (key[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((at[moving] + 1) * (float(1 << 31) / reach)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(), shards), dtype="int32")

    return of(key)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: id, size, checksum, shard, slot and the shard after growing by one.

    ``size`` is the bytes of the UTF-8 text plus one, ``text_crc32`` its CRC-32;
    a null text counts as empty for both. Shards depend on ``doc_id`` and the
    number of shards alone; a null id counts as 0, and rows that share an id
    share a shard. ``slot`` numbers the rows of a shard from 0 in the order of
    ids, nulls first, and of rows with one id in the order they are read. Other
    columns are ignored; an empty table gives an empty result.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = docs.select(
        "doc_id", (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"))
    # The row number is stored before it is used, so that it stays as it is.
    return numbered(materialize(rows, "sharded"), ["shard"], ["doc_id", "_row"], "slot").drop("_row")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
