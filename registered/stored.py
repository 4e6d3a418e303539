"""Queries over scans and plans that are first written from the given tables and then read back."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from registered.base import NOW_MS, query, using
from registered.checks import _trash_sql, trash_parts
from registered.plans import AFTER, ENTRIES, OUTCOMES, entries_of, outcomes_of
from stowage.inventory_views import view
from stowage.plans import build, edit
from stowage.session import work_dir
from stowage.sources import catalogs, inventory, plan_store, scan_store, versions
from stowage.streaming import live

DRIVES = ("D0", "D1", "D2", "D3")


def _folder(spark, label):
    return f"{work_dir(spark)}/stowage/{label}-{uuid.uuid4().hex}"


def written_scans(spark, sf_dir):
    """Headers of one NDJSON scan for each drive, in several files by path; a broken line stands behind every record."""
    folder = _folder(spark, "scans")
    # A compressed file is read by one task, so there are more of them where Spark is told to make more tasks.
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = view(spark, sf_dir, "files_li").repartitionByRange(parts, "drive_name", "path").sortWithinPartitions(
        "drive_name", "path")
    record = F.to_json(F.struct("name", "path", "size", "mtime", "ext"))
    lines = files.select("drive_name", F.explode(F.array(record, F.concat(F.lit("{"), record))).alias("value"))
    lines.write.partitionBy("drive_name").text(f"{folder}/records", compression="gzip")
    unread = files.filter("size = 4").select(
        "drive_name", F.to_json(F.struct("path", F.lit("EACCES").alias("error"))).alias("value"))
    unread.write.partitionBy("drive_name").text(f"{folder}/errors", compression="gzip")
    headers = [f"{folder}/{drive}.header.json" for drive in DRIVES]
    for drive, header in zip(DRIVES, headers):
        plan_store.write_header(spark, {
            "root": f"/Volumes/{drive}", "ndjson": f"records/drive_name={drive}", "errors": f"errors/drive_name={drive}",
        }, header)
    return headers


@query("scans_from_ndjson", using("files_li", """
select scan_order, drive_name, root, name, path, size, mtime, ext,
  row_number() over (partition by scan_order order by path) - 1 as ord from files_li"""))
def _(spark, sf_dir):
    files, _, _ = inventory.read_scans(spark, written_scans(spark, sf_dir))
    return files.select("scan_order", "drive_name", "root", "name", "path", "size", "mtime", "ext", "ord")


@query("scan_errors_from_ndjson", using("files_li", """
select scan_order, drive_name, path, 'EACCES' as error from files_li where size = 4"""))
def _(spark, sf_dir):
    _, sources, _ = inventory.read_scans(spark, written_scans(spark, sf_dir))
    return inventory.read_errors(spark, sources).select("scan_order", "drive_name", "path", "error")


@query("stream_apply_outcomes", using("files_li", "select src_path, status, error, copied_at from after",
                                      entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    plan, told = _folder(spark, "plan"), _folder(spark, "outcomes")
    entries = entries_of(spark, sf_dir)
    plan_store.write_plan(spark, entries, {"id": "p"}, plan)
    outcomes = outcomes_of(entries).withColumn("seq", F.lit(0))
    outcomes.write.parquet(told)
    stream = spark.readStream.schema(outcomes.schema).parquet(told)
    live.stream_apply_outcomes(stream, plan, ["seq"], f"{told}-checkpoint").awaitTermination()
    return plan_store.read_plan(spark, plan)[0].select("src_path", "status", "error", "copied_at")


def written_parts(spark, sf_dir):
    """A folder with one scan for each drive: a header file, a folder of records and one of errors."""
    folder = _folder(spark, "parts")
    files = view(spark, sf_dir, "files_li")
    record = F.to_json(F.struct("name", "path", "size", "mtime", "ext"))
    for drive in DRIVES:
        own = files.filter(F.col("drive_name") == drive)
        own.select(record.alias("value")).write.text(f"{folder}/{drive}.ndjson")
        own.filter("size = 4").select(F.to_json(F.struct("path", F.lit("EACCES").alias("error"))).alias("value")).write.text(
            f"{folder}/{drive}.errors.ndjson")
        versions.create_if_absent(spark, f"{folder}/{drive}.header.json", json.dumps({"root": f"/Volumes/{drive}"}))
    return folder


@query("stream_scan_totals_ndjson", using("files_li", """
select drive_name as scan, count(*) as file_count, cast(sum(size) as bigint) as total_bytes,
  count(*) filter (size = 4) as error_count from files_li group by drive_name"""))
def _(spark, sf_dir):
    records = live.stream_inventory(spark, written_parts(spark, sf_dir), max_files=8)
    return live.run_to_table(live.stream_scan_totals(records), "complete")


_RECORD = """'{"name":"' || name || '","path":"' || path || '","size":' || size || ',"mtime":' || mtime || ',"ext":"' || ext || '"}'"""


@query("scan_catalog", using("files_li", f"""
select drive_name || '.header.json' as file, drive_name || '.ndjson' as ndjson,
  cast(sum(strlen({_RECORD}) + 1) + strlen('{{"root": "/Volumes/D0"}}') as bigint) as size from files_li group by drive_name"""))
def _(spark, sf_dir):
    return catalogs.scan_catalog(spark, written_parts(spark, sf_dir)).select("file", "ndjson", "size")


@query("plan_catalog", using("files_li", """
select drive_name as file, 'plan ' || drive_name as name, count(*) as total_files, cast(sum(size) as bigint) as total_bytes
from files_li group by drive_name"""))
def _(spark, sf_dir):
    folder = _folder(spark, "plans")
    files = view(spark, sf_dir, "files_li").select(F.col("path").alias("src_path"), "size", "mtime", "ext", "drive_name")
    for drive in DRIVES:
        entries = edit.manual_entry(files.filter(F.col("drive_name") == drive))
        totals = edit.recompute_totals(entries).first()
        header = {"name": f"plan {drive}", "totalFiles": totals.total_files, "totalBytes": totals.total_bytes}
        for name in ("draft", header["name"]):
            plan_store.write_plan(spark, entries, {**header, "name": name}, f"{folder}/{drive}")
    return catalogs.plan_catalog(spark, folder).select(
        "file", "header.name", F.col("header.totalFiles").alias("total_files"), F.col("header.totalBytes").alias("total_bytes"))


def _scan_with_log(spark, sf_dir):
    """A stored scan after its retention was set and its log checked."""
    log, inventory_, now_there, mounts = trash_parts(spark, sf_dir)
    folder = _folder(spark, "scan")
    scan_store.write_scan(spark, folder, None, inventory_, {"root": "/"}, replace(log, retention=None))
    scan_store.set_scan_retention(spark, folder, "30d")
    scan_store.reconcile_scan(spark, folder, now_there, mounts, NOW_MS)
    return scan_store.read_scan(spark, folder)


@query("trash_log_round_trip", _trash_sql("""
select path, outcome as status, '30d' as retention from checked where outcome not in ('pruned', 'deleted', 'acknowledged')"""))
def _(spark, sf_dir):
    scan = _scan_with_log(spark, sf_dir)
    return scan.log.entries.select("path", "status", F.lit(scan.log.retention).alias("retention"))


@query("trash_scan_round_trip", _trash_sql("""
select path, size, count(*) over () as file_count, cast(sum(size) over () as bigint) as total_bytes
from checked where outcome <> 'deleted'"""))
def _(spark, sf_dir):
    scan = _scan_with_log(spark, sf_dir)
    totals = {k: F.lit(scan.header[v]).cast("long") for k, v in (("file_count", "fileCount"), ("total_bytes", "totalBytes"))}
    return scan.records.select("path", "size").withColumns(totals)


@query("trash_log_appended", using("outcomes_ev files_pg", """
select src_path as path, case when status in ('copied', 'skipped-exists') then 'trashed'
  when status = 'source-missing' then 'restored' else 'deleted' end as status from outcomes_ev
union all select path, 'trashed' from files_pg"""))
def _(spark, sf_dir):
    log, inventory_, _, _ = trash_parts(spark, sf_dir)
    folder = _folder(spark, "scan")
    scan_store.write_scan(spark, folder, None, inventory_, {"root": "/"}, log)
    pages = view(spark, sf_dir, "files_pg").select("path", "page_id")
    known = log.entries.select("path", F.lit(0).cast("long").alias("page_id"))
    return scan_store.log_trashed(
        spark, folder, pages.unionByName(known), "2024-01-15T12:00:00.000Z", ["page_id"]).log.entries.select("path", "status")


@query("plan_compacted", using("files_li", "select src_path, status, error, copied_at from after",
                               entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    """Outcomes told in two halves, the second before the first was compacted and again after."""
    # Stored, as the plan and each half of its outcomes are made of it.
    plan, entries = _folder(spark, "plan"), build.kept(entries_of(spark, sf_dir))
    plan_store.write_plan(spark, entries, {"id": "p"}, plan)
    outcomes = outcomes_of(entries).withColumn("seq", F.lit(0))
    half = F.pmod(F.xxhash64("src_path"), F.lit(2))
    for n in (0, 1, 1):
        plan_store.tell_outcomes(spark, plan, outcomes.filter(half == n), ["seq"], n)
        plan_store.compact_plan(spark, plan)
    return plan_store.read_plan(spark, plan)[0].select("src_path", "status", "error", "copied_at")
