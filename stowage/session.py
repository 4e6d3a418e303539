"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "stowage", partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STOWAGE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a fresh temporary folder; a cluster session is refused,
    because executors cannot see one machine's temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str = "part", by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    With ``by`` the rows lie in a folder per value of that column, so that a
    reader of one value does not open the others.

    Cuts lineage, keeps column pruning for later readers, and survives the
    loss of executors because the table is not held by them.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stowage/{label}-{uuid.uuid4().hex}"
    many = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(many, None)
    if by:
        # Tasks keep a file open for each of a few values; otherwise Spark sorts all rows by them.
        spark.conf.set(many, "16")
    try:
        # Names and paths repeat each other, which zstd makes smaller than the default does.
        df.write.parquet(path, partitionBy=by, compression="zstd")
    finally:
        if by:
            spark.conf.unset(many) if before is None else spark.conf.set(many, before)
    return spark.read.schema(df.schema).parquet(path)
