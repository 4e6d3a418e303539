"""Trash logs: one JSON document per scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.plans.trash import TrashLog
from stowage.schemas import TRASH_LOG
from stowage.sources.inventory import _exists

_EMPTY = "path string, queued_at string, status string"


def read_trash_log(spark: SparkSession, path: str) -> TrashLog:
    """A missing or unreadable file is an empty log."""
    if not _exists(spark, path):
        return TrashLog(spark.createDataFrame([], _EMPTY))
    document = spark.read.text(path, wholetext=True).filter("try_parse_json(value) is not null").select(
        F.from_json("value", TRASH_LOG).alias("log"))
    head = document.select("log.retentionOverride").first()
    entries = document.select(F.explode("log.entries").alias("e")).select(
        "e.path", F.col("e.queuedAt").alias("queued_at"), "e.status")
    return TrashLog(entries, head[0] if head else None)


def trash_log_table(log: TrashLog) -> DataFrame:
    """Rows in the shape of the stored document, one JSON object per entry."""
    return log.entries.select("path", F.col("queued_at").alias("queuedAt"), "status")
