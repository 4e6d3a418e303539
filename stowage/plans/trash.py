"""The audit log of files sent to the trash, and its check against a fresh inventory."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import volume_of
from stowage.operators.dedup import first_in_batch
from stowage.operators.reports import bytes_of
from stowage.operators.skew import join_keys

# Retention windows in milliseconds; None keeps everything.
WINDOWS = {"forever": None, "24h": 24 * 3600 * 1000, "30d": 30 * 24 * 3600 * 1000}


@dataclass(frozen=True)
class TrashLog:
    """Log entries ``(path, queued_at text, status)`` and the scan's own retention, if it has one."""

    entries: DataFrame
    retention: str | None = None


def window_ms(*labels: str | None) -> int | None:
    """Window of the first label that is set."""
    label = next((x for x in labels if x), "forever")
    return WINDOWS.get(label)


def set_retention(log: TrashLog, label: str | None) -> TrashLog:
    if label and label not in WINDOWS:
        raise ValueError(f"invalid retention: {label!r}")
    return replace(log, retention=label or None)


def queued_ms(column="queued_at") -> Column:
    """Queue time in epoch milliseconds; null when it is missing or unreadable."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(F.try_to_timestamp(column))


def _kept(limit: int | None, now_ms: int) -> Column:
    if limit is None:
        return F.lit(True)
    return F.coalesce(queued_ms() >= now_ms - limit, F.lit(False))


def apply_retention(log: TrashLog, now_ms: int, label: str | None = None, default: str | None = None) -> TrashLog:
    """Drop entries older than the window; ``label`` beats the log's own, which beats ``default``."""
    return replace(log, entries=log.entries.filter(_kept(window_ms(label, log.retention, default), now_ms)))


def trash_append(log: TrashLog, paths: DataFrame, queued_at: str, order: list[str]) -> TrashLog:
    """Log newly trashed paths. A path already in the log is left as it is."""
    new = first_in_batch(paths, "path", order).join(log.entries.select("path"), "path", "left_anti")
    rows = new.select("path", F.lit(queued_at).alias("queued_at"), F.lit("trashed").alias("status"))
    return replace(log, entries=log.entries.unionByName(rows))


@dataclass(frozen=True)
class Reconciled:
    log: TrashLog
    inventory: DataFrame
    checked: DataFrame  # every log entry with its outcome
    gone: DataFrame

    def totals(self, header: dict) -> dict:
        """Header with fresh totals, recomputed only if something is gone."""
        if self.gone.limit(1).count() == 0:
            return header
        row = self.inventory.agg(F.count("*").alias("n"), bytes_of().alias("b")).first()
        return {**header, "fileCount": row.n, "totalBytes": row.b}

    def report(self, before: DataFrame) -> DataFrame:
        """One row: checked, removed, restored, restored_acked, retention_pruned, still_pending."""
        outcome = F.col("outcome")
        counts = self.checked.agg(
            F.count_if(outcome != "pruned").alias("checked"),
            F.count_if(outcome == "restored").alias("restored"),
            F.count_distinct(F.when(outcome == "acknowledged", F.col("path"))).alias("restored_acked"),
            F.count_if(outcome == "pruned").alias("retention_pruned"),
            F.count_if(outcome == "trashed").alias("still_pending"),
        )
        removed = before.join(self.gone, "path", "left_semi").agg(F.count("*").alias("removed"))
        # Both sides are one-row totals.
        return counts.withColumn("_one", F.lit(1)).join(removed.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reconcile_trash(
    log: TrashLog, inventory: DataFrame, live: DataFrame, mounts: DataFrame, now_ms: int,
    label: str | None = None, default: str | None = None,
) -> Reconciled:
    """Compare the log with what is there now.

    ``live`` is a fresh inventory (``path``), ``mounts`` the mounted volumes
    (``path``). Restored entries stay one more round and are then dropped; an
    entry on a volume that is not mounted stays as it is; what is neither
    there nor offline is gone, and leaves both the log and the inventory.
    """
    kept = _kept(window_ms(label, log.retention, default), now_ms)
    entries = log.entries.withColumn("_volume", volume_of("path"))
    present = live.select(F.col("path")).distinct().withColumn("_live", F.lit(True))
    volumes = mounts.select(F.col("path").alias("_volume")).distinct().withColumn("_mounted", F.lit(True))
    joined = join_keys(entries.join(present, "path", "left"), volumes, ["_volume"], "left")
    offline = F.col("_volume").isNotNull() & F.col("_mounted").isNull()
    outcome = (
        F.when(~kept, F.lit("pruned"))
        .when(F.col("status") == "restored", F.lit("acknowledged"))
        .when(F.col("status") == "deleted", F.lit("deleted"))
        .when(offline, F.col("status"))
        .when(F.col("_live"), F.lit("restored"))
        .otherwise(F.lit("deleted"))
    )
    checked = joined.select("path", "queued_at", "status", outcome.alias("outcome"))
    gone = checked.filter("outcome = 'deleted'").select("path").distinct()
    acknowledged = checked.filter("outcome = 'acknowledged'").select("path").distinct()
    left = (
        checked.filter("outcome not in ('pruned', 'deleted')").join(acknowledged, "path", "left_anti")
        .select("path", "queued_at", F.col("outcome").alias("status"))
    )
    return Reconciled(replace(log, entries=left), inventory.join(gone, "path", "left_anti"), checked, gone)
