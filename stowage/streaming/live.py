"""Streaming forms of the scan counters, the run counters, and duplicate removal.

None of them uses event time: the counters have one row per scan, run or
drive, so their state is bounded. Only ``stream_dedupe`` keeps a row per
distinct file, unless a watermark is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.dedup import KEY
from stowage.operators.reports import bytes_if, bytes_of
from stowage.schemas import INVENTORY
from stowage.session import work_dir
from stowage.sources.inventory import _file_key, _variant_fields
from stowage.sources.plan_store import tell_outcomes


def stream_inventory(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Records of NDJSON scans as their files land below ``folder``; error files give rows with ``is_error``.

    A scan ``s`` is a file ``s.ndjson``, files ``s.part-1.ndjson``, ... or a
    folder ``s.ndjson`` of parts; its errors the same with ``s.errors``.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.ndjson,part-*}")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    named = F.regexp_extract("key", r"([^/]+)[.]ndjson(?:/|$)", 1)
    lines = reader.text(folder).select(
        F.try_parse_json("value").alias("json"), _file_key("_metadata.file_path").alias("key"))
    valid = lines.filter("json is not null").withColumn("named", named).filter("named <> ''")
    return valid.select(
        F.regexp_replace("named", r"(?:[.]part-?\d+)?(?:[.]errors)?$", "").alias("scan"),
        F.endswith("named", F.lit(".errors")).alias("is_error"), *_variant_fields("json", INVENTORY))


def stream_scan_totals(records: DataFrame) -> DataFrame:
    """Files, bytes and errors per scan so far."""
    return records.groupBy("scan").agg(
        F.count_if(~F.col("is_error")).alias("file_count"), bytes_if(~F.col("is_error")).alias("total_bytes"),
        F.count_if(F.col("is_error")).alias("error_count"))


def stream_run_status(outcomes: DataFrame, by: tuple[str, ...] = ("run_id", "drive_name")) -> DataFrame:
    """Copied, skipped and failed files, and copied bytes, per run and drive so far."""
    status = F.col("status")
    return outcomes.groupBy(*by).agg(
        F.count_if(status == "copied").alias("copied_files"), bytes_if(status == "copied").alias("copied_bytes"),
        F.count_if(status == "skipped-exists").alias("skipped_files"),
        F.count_if(status.isin("failed", "source-missing")).alias("failed_files"), bytes_of().alias("seen_bytes"))


def stream_dedupe(files: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First arrival of every (size, name, extension).

    Append-only, so only the first-scanned rule can be streamed. A watermark
    ``(column, delay)`` bounds the state and lets later repeats through.
    """
    files = files.withColumn("ext", F.coalesce("ext", F.lit("")))
    if watermark is None:
        return files.dropDuplicates(KEY)
    return files.withWatermark(*watermark).dropDuplicatesWithinWatermark(KEY)


def stream_apply_outcomes(outcomes: DataFrame, plan_folder: str, order: list[str], checkpoint: str, stream: str = "run"):
    """Add a stream of copy outcomes to a stored plan.

    Every micro-batch writes its own rows and no more; whoever reads the plan
    sees them merged. A batch that runs again after a failure is told once.
    """
    def tell(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            tell_outcomes(batch.sparkSession, plan_folder, batch, order, batch_id, stream)

    return (outcomes.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available now into a stored table and return it.

    ``complete`` keeps the result of the last micro-batch.
    """
    spark = stream.sparkSession
    base = f"{work_dir(spark)}/stowage/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    last = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{batch_id}")
        last.append(batch_id)

    writer.foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/batch-{last[-1]}")
