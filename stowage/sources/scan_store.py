"""Stored scans: records, header, trash log and its own retention as one version.

A reconciliation changes three things at once (the records lose what is gone,
the header its totals, the log its entries); readers see all of them or none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stowage.plans.trash import TrashLog, reconcile_trash, set_retention, trash_append
from stowage.sources import versions
from stowage.sources.versions import Version

LOG = "path string, queued_at string, status string"


@dataclass(frozen=True)
class StoredScan:
    version: Version
    records: DataFrame
    log: TrashLog

    @property
    def header(self) -> dict:
        return self.version.content["header"]


def read_scan(spark: SparkSession, folder: str) -> StoredScan:
    """The newest version of a scan; a scan without a log has an empty one."""
    version = versions.latest(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no scan in {folder}")
    content = version.content
    log = spark.read.schema(LOG).parquet(f"{folder}/{content['log']}") if content["log"] else spark.createDataFrame([], LOG)
    return StoredScan(version, spark.read.parquet(f"{folder}/{content['records']}"), TrashLog(log, content["retention"]))


def write_scan(
    spark: SparkSession, folder: str, base: StoredScan | None, records: DataFrame | None = None,
    header: dict | None = None, log: TrashLog | None = None,
) -> StoredScan:
    """Commit a version behind ``base`` (None: the first). What is not given stays as it is in ``base``.

    Raises ``StaleVersion`` if another version came first. Only given tables
    are written; a log with the entries of ``base`` changes the retention alone.
    """
    old = base.version.content if base else {"records": None, "header": {}, "log": None, "retention": None}
    if base is None and records is None:
        raise ValueError("a new scan has records")
    content = dict(old)
    if header is not None:
        content["header"] = header
    if log is not None:
        content["retention"] = log.retention
        if base is None or log.entries is not base.log.entries:
            content["log"] = _write(log.entries, folder, "log")
    if records is not None:
        content["records"] = _write(records, folder, "records")
    versions.commit(spark, folder, base.version if base else None, content)
    return read_scan(spark, folder)


def _write(table: DataFrame, folder: str, name: str) -> str:
    path = versions.new_table(folder, name)
    table.write.parquet(path)
    return path[len(folder) + 1:]


def set_scan_retention(spark: SparkSession, folder: str, label: str | None) -> StoredScan:
    """Give the scan a retention of its own, or with None that of all scans again."""
    scan = read_scan(spark, folder)
    return write_scan(spark, folder, scan, log=set_retention(scan.log, label))


def log_trashed(spark: SparkSession, folder: str, paths: DataFrame, queued_at: str, order: list[str]) -> StoredScan:
    """Add newly trashed paths to the scan's log."""
    scan = read_scan(spark, folder)
    return write_scan(spark, folder, scan, log=trash_append(scan.log, paths, queued_at, order))


def reconcile_scan(
    spark: SparkSession, folder: str, live: DataFrame, mounts: DataFrame, now_ms: int, default: str | None = None,
) -> tuple[StoredScan, dict]:
    """Compare the scan's log with what is there now, and commit log, records and totals together.

    The report has the counts of ``Reconciled.report``. Records are written
    only if something is gone.
    """
    scan = read_scan(spark, folder)
    done = reconcile_trash(scan.log, scan.records, live, mounts, now_ms, default=default)
    report = done.report(scan.records).first().asDict()
    records = done.inventory if report["removed"] else None
    header = done.totals(scan.header)
    return write_scan(spark, folder, scan, records, header, done.log), report
