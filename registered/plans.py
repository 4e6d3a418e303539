"""Queries over plan entries: editing, resetting, outcomes, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import query, using
from stowage.inventory_views import view
from stowage.operators import reports
from stowage.operators.rules import ProjectSettings
from stowage.plans import build, edit, preflight
from stowage.sources import plan_store

ENTRIES = """select path as src_path, drive_name,
  case when rn = 1 then drive_name || '/' || substring(path, length(root) + 2) end as dst_rel_path, size, mtime, ext,
  case when rn = 1 then 'pending' else 'skipped-duplicate' end as status
from (select *, row_number() over (partition by size, name, ext order by scan_order, path) as rn from files_li)"""
# What a copier reported for the pending entries: by extension, so that every status turns up.
OUTCOMES = """select src_path, drive_name, case ext when 'jpg' then 'copied' when 'mp4' then 'failed' else 'source-missing' end
  as status, case ext when 'mp4' then 'EIO' end as error, mtime as at from entries where status = 'pending'"""
AFTER = """select e.src_path, coalesce(o.status, e.status) as status, o.error, e.size,
  case when o.status = 'copied' then o.at end as copied_at
from entries e left join outcomes o on o.src_path = e.src_path"""


def entries_of(spark, sf_dir):
    options = build.PlanOptions(projects=ProjectSettings(enabled=False), order=("scan_order", "path"))
    return build.build_plan(view(spark, sf_dir, "files_li"), options).entries


def outcomes_of(entries):
    return entries.filter("status = 'pending'").select(
        "src_path", "drive_name",
        F.when(F.col("ext") == "jpg", "copied").when(F.col("ext") == "mp4", "failed").otherwise("source-missing").alias("status"),
        F.when(F.col("ext") == "mp4", "EIO").alias("error"), F.col("mtime").alias("at"))


@query("plan_add_new", using("files_li outcomes_ev", """
select src_path, drive_name, size, 'f' || event_id as name, 'manual::' || src_path as dupe_key, 'pending' as status
from outcomes_ev""", entries=ENTRIES))
def _(spark, sf_dir):
    return _added(spark, sf_dir).new.select("src_path", "drive_name", "size", "name", "dupe_key", "status")


def _added(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    events = view(spark, sf_dir, "outcomes_ev").select("src_path", "drive_name", "size", F.col("event_id").alias("pick"))
    known = entries.select("src_path", "drive_name", "size", F.lit(-1).cast("long").alias("pick"))
    again = events.withColumn("pick", F.col("pick") + 1_000_000_000).withColumn("size", F.lit(-1).cast("long"))
    return edit.plan_add(entries, events.unionByName(again).unionByName(known), ["pick"])


@query("plan_add_skipped", using("files_li outcomes_ev", """
select src_path, 1 as times from outcomes_ev union all select src_path, count(*) from entries group by src_path""",
    entries=ENTRIES))
def _(spark, sf_dir):
    return _added(spark, sf_dir).skipped.groupBy("src_path").agg(F.count("*").alias("times"))


@query("plan_remove", using("files_li", """
select src_path, status from entries where src_path not in (select path from files_li where scan_order = 2)""",
    entries=ENTRIES))
def _(spark, sf_dir):
    gone = view(spark, sf_dir, "files_li").filter("scan_order = 2").select(F.col("path").alias("src_path"))
    return edit.plan_remove(entries_of(spark, sf_dir), gone).select("src_path", "status")


@query("apply_outcomes", using("files_li", "select src_path, status, error, copied_at from after",
                               entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    return edit.apply_outcomes(entries, outcomes_of(entries)).select("src_path", "status", "error", "copied_at")


@query("apply_outcomes_internal", using("files_li", """
select e.src_path, case when e.status = 'pending' then 'copied' else e.status end as status,
  case when e.status = 'pending' then e.mtime end as copied_at
from (select 'x/' || src_path as src_path, status, mtime from entries) e""", entries=ENTRIES))
def _(spark, sf_dir):
    # Picked files: their entries, and the reports on them, name no drive.
    entries = entries_of(spark, sf_dir).withColumns({
        "src_path": F.concat(F.lit("x/"), "src_path"), "drive_name": F.lit(None).cast("string")})
    told = entries.filter("status = 'pending'").select(
        "src_path", "drive_name", F.lit("copied").alias("status"), F.col("mtime").alias("at"))
    return edit.apply_outcomes(entries, told).select("src_path", "status", "copied_at")


@query("apply_outcomes_repeated", using("files_li", """
select e.src_path, coalesce(o.status, e.status) as status, o.error,
  case when o.status = 'copied' then o.at end as copied_at
from entries e left join outcomes o on o.src_path = e.src_path""", entries=ENTRIES, outcomes=OUTCOMES))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    last = outcomes_of(entries).withColumn("seq", F.lit(2))
    before = last.withColumns({"status": F.lit("failed"), "error": F.lit("EAGAIN"), "seq": F.lit(1)})
    return edit.apply_outcomes(entries, last.unionByName(before), ["seq"]).select(
        "src_path", "status", "error", "copied_at")


@query("plan_reset_unknown", using("files_li", """
select src_path, cast(null as varchar) as status, 'kept' as error, mtime as copied_at from entries""", entries=ENTRIES))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir).withColumns({
        "status": F.lit(None).cast("string"), "error": F.lit("kept"), "copied_at": F.col("mtime")})
    return edit.plan_reset(entries).select("src_path", "status", "error", "copied_at")


@query("stored_plan_order", using("files_li", """
select src_path, status, row_number() over (partition by drive_name order by src_path) as place
from after join (select src_path, drive_name from entries) using (src_path)""",
    entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    import uuid

    from stowage.operators.skew import place_among
    from stowage.session import materialize, work_dir

    folder = f"{work_dir(spark)}/stowage/plan-{uuid.uuid4().hex}"
    first = plan_store.write_plan(spark, build.in_order(entries_of(spark, sf_dir), "src_path"), {"id": "p"}, folder)
    entries, header = plan_store.read_plan(spark, folder)
    # Read once, as the plan and its outcomes are made of it.
    entries = build.kept(entries)
    plan_store.write_plan(spark, edit.apply_outcomes(entries, outcomes_of(entries)), header, folder, first)
    # Read once, as places are counted by range before they are given.
    stored = materialize(plan_store.read_plan(spark, folder)[0].select("src_path", "status", "drive_name", "ord"), "places")
    return place_among(stored, "drive_name", "ord", "place").select("src_path", "status", "place")


@query("plan_reset", using("files_li", """
select src_path, case when status in ('failed', 'source-missing') then 'pending' else status end as status,
  case when status not in ('failed', 'source-missing') then error end as error, copied_at from after""",
    entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    after = edit.apply_outcomes(entries, outcomes_of(entries))
    return edit.plan_reset(after, ["failed", "source-missing"]).select("src_path", "status", "error", "copied_at")


@query("plan_reset_counts", using("files_li", """
select count(*) filter (status in ('copied', 'failed', 'source-missing')) as flipped, count(*) as total from after""",
    entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    return edit.count_resettable(edit.apply_outcomes(entries, outcomes_of(entries)))


@query("plan_save_as", using("files_li", """
select src_path, case when status = 'skipped-duplicate' then status else 'pending' end as status from after""",
    entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    # Stored, as the plan and its outcomes are made of it, once for the totals and once for the copy.
    entries = build.kept(entries_of(spark, sf_dir))
    after = edit.apply_outcomes(entries, outcomes_of(entries))
    return edit.plan_save_as(after, {}, "Copy 1", 0)[0].select("src_path", "status")


@query("totals_after_run", using("files_li", """
select count(*) filter (status in ('pending', 'copied')) as total_files,
  cast(sum(size) filter (status in ('pending', 'copied')) as bigint) as total_bytes,
  count(*) filter (status = 'skipped-duplicate') as duplicates_collapsed,
  count(*) filter (status = 'source-error') as error_count from after""",
    entries=ENTRIES, outcomes=OUTCOMES, after=AFTER))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir)
    return reports.recompute_totals(edit.apply_outcomes(entries, outcomes_of(entries)))


@query("source_error_entries", using("outcomes_ev", """
select src_path, drive_name, 'EACCES' as error, 'source-error' as status, cast(null as bigint) as size
from outcomes_ev where status = 'failed'"""))
def _(spark, sf_dir):
    errors = view(spark, sf_dir, "outcomes_ev").filter("status = 'failed'").select(
        F.col("src_path").alias("path"), "drive_name", F.lit("EACCES").alias("error"))
    return build.error_entries(errors).select("src_path", "drive_name", "error", "status", "size")


@query("drive_groups", using("files_li", """
select 'name:' || drive_name as group_key, cast(null as varchar) as uuid, drive_name, count(*) as files,
  cast(sum(size) as bigint) as bytes, min(src_path) as first_ord
from entries where status = 'pending' group by drive_name""", entries=ENTRIES))
def _(spark, sf_dir):
    return preflight.drive_groups(entries_of(spark, sf_dir), "src_path")


@query("preview", using("files_li", "select src_path, status from entries order by src_path limit 500", entries=ENTRIES))
def _(spark, sf_dir):
    return plan_store.preview(entries_of(spark, sf_dir), 500, "src_path").select("src_path", "status")


@query("stored_plan", using("files_li", """
select src_path, drive_name, dst_rel_path, size, mtime, ext, status from entries""", entries=ENTRIES))
def _(spark, sf_dir):
    import uuid

    from stowage.session import work_dir

    folder = f"{work_dir(spark)}/stowage/plan-{uuid.uuid4().hex}"
    plan_store.write_plan(spark, entries_of(spark, sf_dir), {"id": "p"}, folder)
    return plan_store.read_plan(spark, folder)[0].select(
        "src_path", "drive_name", "dst_rel_path", "size", "mtime", "ext", "status")
