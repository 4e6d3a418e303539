"""Catalogs: which scans and plans a folder holds, newest first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.schemas import PLAN_HEADER
from stowage.sources.inventory import _exists, _file_key, _keys_above
from stowage.sources.plan_store import parse_headers


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Name, size and change time of matching files, read without their content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"),
                F.col("modificationTime").alias("modified"))
    )


def scan_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Scans in ``folder``; the size is that of header and data together, the data one file or a folder of parts."""
    heads = _files(spark, folder, "*.header.json")
    said = (
        spark.read.option("wholetext", "true").option("pathGlobFilter", "*.header.json").text(folder)
        .select(F.col("_metadata.file_name").alias("encoded"), _file_key("_metadata.file_path").alias("key"),
                F.expr("try_variant_get(try_parse_json(value), '$.ndjson', 'string')").alias("named"))
    )
    said = said.select(
        F.element_at(F.split("key", "/"), -1).alias("file"), F.regexp_replace("key", "/[^/]*$", "").alias("home"), "named")
    stem = F.expr("left(file, length(file) - length('.header.json'))")
    scans = heads.join(said, "file").withColumn("ndjson", F.coalesce("named", F.concat(stem, F.lit(".ndjson"))))
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    data = data.select(F.explode(_keys_above("path", encoded=False)).alias("data"), "length").groupBy("data").agg(
        F.sum("length").alias("_data"))
    joined = scans.join(data, F.concat("home", F.lit("/"), "ndjson") == F.col("data"), "left")
    return joined.select(
        "file", (F.col("bytes") + F.coalesce("_data", F.lit(0))).alias("size"), "modified", "ndjson",
    ).orderBy(F.desc("modified"), "file")


def plan_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Plans in ``folder`` with their parsed headers: stored plans at their newest version, and ``*.plan.json`` files."""
    def texts(glob: str, path: str) -> DataFrame:
        return spark.read.option("wholetext", "true").option("pathGlobFilter", glob).text(path).select(
            "value", _file_key("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"))

    found = []
    if _exists(spark, f"{folder}/*.plan.json"):
        found.append(texts("*.plan.json", folder).withColumn("file", F.element_at(F.split("key", "/"), -1)).drop("key"))
    if _exists(spark, f"{folder}/*/log/*.json"):
        stored = texts("*.json", f"{folder}/*/log").withColumn("file", F.element_at(F.split("key", "/"), -3))
        newest = stored.groupBy("file").agg(F.max_by(F.struct("value", "size", "modified"), "key").alias("v"))
        header = F.expr("to_json(try_variant_get(try_parse_json(v.value), '$.header', 'variant'))").alias("value")
        found.append(newest.select(header, "v.size", "v.modified", "file"))
    if not found:
        return spark.createDataFrame([], T.StructType([
            T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType()),
            T.StructField("file", T.StringType()), T.StructField("header", PLAN_HEADER)]))
    return parse_headers(reduce(DataFrame.unionByName, found)).orderBy(F.desc("modified"), "file")
