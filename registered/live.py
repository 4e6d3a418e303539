"""Streaming queries, run over what is available now."""

from __future__ import annotations

from registered.base import query, using
from stowage.inventory_views import stream_view
from stowage.streaming import live


@query("stream_run_status", using("outcomes_ev", """
select drive_name, count(*) filter (status = 'copied') as copied_files,
  cast(coalesce(sum(size) filter (status = 'copied'), 0) as bigint) as copied_bytes,
  count(*) filter (status = 'skipped-exists') as skipped_files,
  count(*) filter (status in ('failed', 'source-missing')) as failed_files, cast(sum(size) as bigint) as seen_bytes
from outcomes_ev group by drive_name"""))
def _(spark, sf_dir):
    outcomes = stream_view(spark, sf_dir, "outcomes_ev")
    return live.run_to_table(live.stream_run_status(outcomes, ("drive_name",)), "complete")


@query("stream_scan_totals", using("files_li", """
select drive_name as scan, count(*) as file_count, cast(sum(size) as bigint) as total_bytes, 0::bigint as error_count
from files_li group by drive_name"""))
def _(spark, sf_dir):
    from pyspark.sql import functions as F

    files = stream_view(spark, sf_dir, "files_li")
    records = files.withColumn("scan", F.col("drive_name")).withColumn("is_error", F.lit(False))
    return live.run_to_table(live.stream_scan_totals(records), "complete")


@query("stream_dedupe", using("files_li", "select distinct size, name, ext from files_li"))
def _(spark, sf_dir):
    return live.run_to_table(live.stream_dedupe(stream_view(spark, sf_dir, "files_li"))).select("size", "name", "ext")
