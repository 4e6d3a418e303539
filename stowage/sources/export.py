"""Export of a filtered inventory to files that keep its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.operators.filters import FilterSpec, filter_inventory
from stowage.operators.skew import running_count

FORMATS = ("csv", "json")
# Fields with quotes, line ends and blanks at their ends come back as they were, and empty text is not null.
_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# What the reader takes an empty field for, and what a quoted empty one; no name or path holds a NUL.
_NULLS = {"nullValue": "\0null", "emptyValue": ""}


def _options(kind: str) -> dict[str, str]:
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind!r}")
    return _CSV if kind == "csv" else {"ignoreNullFields": "false"}


def export_filtered(
    files: DataFrame, spec: FilterSpec, path: str, order: list[str], kind: str = "csv", now_ms: int | None = None,
    rows_per_file: int = 1_000_000,
) -> None:
    """Write the files that ``spec`` leaves, with their ``position`` in ``order`` (from 0).

    Rows are sorted and numbered by range, not in one task; parts follow each
    other in the order of their names. ``order`` should tell rows apart.
    """
    options = _options(kind)
    kept = filter_inventory(files, spec, now_ms).withColumn("_all", F.lit(0))
    placed = running_count(kept, "_all", order, F.lit(True), "position").drop("_all")
    placed = placed.withColumn("position", (F.col("position") - 1).cast("long"))
    (placed.repartitionByRange("position").sortWithinPartitions("position").write.options(**options)
     .option("maxRecordsPerFile", rows_per_file).format(kind).save(path))


def read_export(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """Rows of an export; ``schema`` is that of the exported inventory, to which ``position`` is added."""
    options = _options(kind) | ({"multiLine": "true"} | _NULLS if kind == "csv" else {})
    full = T.StructType([*schema.fields, T.StructField("position", T.LongType())])
    return spark.read.options(**options).schema(full).format(kind).load(path)
