"""Queries that compare a plan or a log with what is present and mounted."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import NOW_MS, query, using
from registered.plans import ENTRIES, entries_of
from stowage.inventory_views import view
from stowage.operators.flat_names import resolve_flat_names
from stowage.operators.projects import own_folders
from stowage.plans import preflight, trash

MOUNTS = """select '/Volumes/' || case r_regionkey when 0 then 'D0' when 1 then 'D2' when 2 then 'D3' else 'Other' || r_regionkey end
  as path from region"""


def mounts_of(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return spark.sql(MOUNTS.replace("from region", "from {region}"), region=region)


VERIFIED = """select src_path, drive_name, case when m.path is null then 'offline' when ext <> 'pdf' then 'ok' else 'missing' end as "check"
from entries e left join mounts m on starts_with(e.src_path, m.path || '/') where status = 'pending'"""


def _verified(spark, sf_dir):
    live = view(spark, sf_dir, "files_li").filter("ext <> 'pdf'")
    return preflight.verify_sources(entries_of(spark, sf_dir), live, mounts_of(spark, sf_dir))


@query("verify_sources", using("files_li", """select src_path, "check" from verified""",
                               entries=ENTRIES, mounts=MOUNTS, verified=VERIFIED))
def _(spark, sf_dir):
    return _verified(spark, sf_dir).select("src_path", "check")


@query("verify_summary", using("files_li", """
select drive_name as drive, count(*) as total, count(*) filter ("check" = 'ok') as ok,
  count(*) filter ("check" = 'missing') as missing, count(*) filter ("check" = 'offline') as drive_offline
from verified group by rollup (drive_name)""", entries=ENTRIES, mounts=MOUNTS, verified=VERIFIED))
def _(spark, sf_dir):
    return preflight.verify_summary(_verified(spark, sf_dir))


_NAMED_MOUNTS = """select '/Volumes/M' || r_regionkey as path,
  case r_regionkey when 0 then 'D0' when 1 then 'd1' when 2 then 'D2 1' when 3 then 'd1 7' else 'D33' end as name,
  cast(null as varchar) as uuid, r_regionkey as ord from region"""


def _matched(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    mounts = spark.sql(_NAMED_MOUNTS.replace("from region", "from {region}").replace("varchar", "string"), region=region)
    return preflight.match_mounts(preflight.drive_groups(entries_of(spark, sf_dir), "src_path"), mounts)


@query("match_mounts", using("files_li", """
select 'name:' || d.drive_name as group_key, t.tier, t.path as mount_path, t.name as mount_name, t.path is null as needs_swap
from (select distinct drive_name from entries where status = 'pending') d
left join (select *, row_number() over (partition by drive_name order by tier, ord) as rn from (
  select e.drive_name, m.*, case when m.name = e.drive_name then 2 when lower(m.name) = lower(e.drive_name) then 3
    when starts_with(lower(m.name), lower(e.drive_name) || ' ') or starts_with(lower(e.drive_name), lower(m.name) || ' ') then 4
    end as tier from (select distinct drive_name from entries) e, mounts m) where tier is not null) t
  on t.drive_name = d.drive_name and t.rn = 1""", entries=ENTRIES, mounts=_NAMED_MOUNTS))
def _(spark, sf_dir):
    return _matched(spark, sf_dir).select("group_key", "tier", "mount_path", "mount_name", "needs_swap")


@query("current_sources", using("files_li", """
select src_path, case drive_name when 'D0' then '/Volumes/M0' when 'D1' then '/Volumes/M1' when 'D2' then '/Volumes/M2'
  else '/Volumes/D3' end || substring(src_path, 12) as src_now from entries""", entries=ENTRIES))
def _(spark, sf_dir):
    return preflight.current_sources(entries_of(spark, sf_dir), _matched(spark, sf_dir)).select("src_path", "src_now")


@query("space_check", using("files_li", """
select cast(sum(size) as bigint) as pending_bytes, 1000000000 >= sum(size) + 1073741824 as fits
from entries where status = 'pending'""", entries=ENTRIES))
def _(spark, sf_dir):
    return preflight.space_check(entries_of(spark, sf_dir), 1_000_000_000)


@query("predict_outcomes_additive", using("files_li", """
select src_path, '/Volumes/Backup/' || dst_rel_path as dst_path,
  case when ext = 'pdf' then 'source-missing' when ext = 'jpg' then 'skipped-exists' else 'copied' end as predicted
from entries where status = 'pending'""", entries=ENTRIES))
def _(spark, sf_dir):
    return _predicted(spark, sf_dir, "additive").select("src_path", "dst_path", "predicted")


@query("predict_outcomes_fresh", using("files_li", """
select src_path, case when ext = 'pdf' then 'source-missing' when ext = 'jpg' then 'failed' else 'copied' end as predicted,
  case when ext = 'jpg' then 'EEXIST' end as reason
from entries where status = 'pending'""", entries=ENTRIES))
def _(spark, sf_dir):
    return _predicted(spark, sf_dir, "fresh").select("src_path", "predicted", "reason")


def _predicted(spark, sf_dir, mode):
    files = view(spark, sf_dir, "files_li")
    there = files.filter("ext = 'jpg'").select(
        F.concat(F.lit("/Volumes/Backup/"), "drive_name", F.expr("substring(path, length(root) + 1)")).alias("path"))
    resolved = preflight.resolve_destinations(entries_of(spark, sf_dir), "/Volumes/Backup", "mirrored", there, "src_path")
    return preflight.predict_outcomes(resolved, files.filter("ext <> 'pdf'"), there, "/Volumes/Backup/", mode, "src_path")


@query("predict_outcomes_flat", using("files_li", """
select src_path, case when scan_order <> 1 then '/Volumes/Backup/' || case when slot = 1 then name
    else regexp_replace(name, '\\.[^.]*$', '') || ' (' || slot || ').' || ext end end as dst_path,
  case when scan_order = 1 then 'source-missing' else 'copied' end as predicted
from (select path as src_path, name, ext, scan_order,
    row_number() over (partition by name, scan_order = 1 order by path) as slot
  from (select *, row_number() over (partition by size, name, ext order by scan_order, path) as rn from files_li)
  where rn = 1)"""))
def _(spark, sf_dir):
    files = view(spark, sf_dir, "files_li")
    live, nothing = files.filter("scan_order <> 1"), files.select("path").limit(0)
    resolved = preflight.resolve_destinations(
        entries_of(spark, sf_dir), "/Volumes/Backup", "flat", nothing, "src_path", live=live)
    return preflight.predict_outcomes(resolved, live, nothing, "/Volumes/Backup", "additive", "src_path").select(
        "src_path", "dst_path", "predicted")


@query("predict_outcomes_offline", using("files_li", """
select src_path, case drive_name when 'D1' then 'skipped-volume-unavailable' when 'D2' then 'failed'
    else case when ext = 'pdf' then 'source-missing' else 'copied' end end as predicted
from entries where status = 'pending' and (drive_name <> 'D2' or ext <> 'pdf')""", entries=ENTRIES))
def _(spark, sf_dir):
    files = view(spark, sf_dir, "files_li")
    live, nothing = files.filter("ext <> 'pdf'"), files.select("path").limit(0)
    entries = entries_of(spark, sf_dir).withColumn("needs_swap", F.col("drive_name") == "D1")
    resolved = preflight.resolve_destinations(entries, "/Volumes/Backup", "mirrored", nothing, "src_path", live=live)
    out = preflight.predict_outcomes(resolved, live, nothing, "/Volumes/Backup", "overwrite", "src_path",
                                     protected=["/Volumes/Backup/D2"])
    return out.filter("drive_name <> 'D2' or ext <> 'pdf'").select("src_path", "predicted")


@query("flat_names", using("files_li", """
select path, case when slot = 1 then name else regexp_replace(name, '\\.[^.]*$', '') || ' (' || slot || ').' || ext end as dst_name
from (select path, name, ext, case when ext = 'mp4' and p_partkey is not null then case when p_size > 25 then 2 else 1 end else 0 end
        + row_number() over (partition by name order by path) as slot
      from files_li left join part on name = 'part_' || p_partkey || '.mp4')"""))
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    stem = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    there = part.select(F.concat(stem, F.lit(".mp4")).alias("name")).unionByName(
        part.filter("p_size > 25").select(F.concat(stem, F.lit(" (2).mp4")).alias("name")))
    files = view(spark, sf_dir, "files_li").select("path", F.col("path").alias("src_path"), "name")
    return resolve_flat_names(files, there, ["path"]).select("path", "dst_name")


@query("flat_names_numbered", using("files_li", """
select path, case
    when not is_slot and slot = 1 then stem || ext
    when not is_slot then stem || ' (' || slot || ')' || ext
    when is_first or requests < 2 then stem || ' (2)' || ext else stem || ' (2) (2)' || ext end as dst_name
from (select *, rank + cast(is_first and rank > 1 as int) as slot from wanted)""", wanted="""
select path, false as is_slot, regexp_replace(name, '\\.[^.]*$', '') as stem, '.' || ext as ext,
  cast(regexp_extract(name, '[0-9]+') as int) % 2 = 0 as is_first,
  row_number() over (partition by name order by path) as rank, 0 as requests from files_li
union all
select case when is_first then '/A/' else '/z/' end || stem || ext, true, stem, ext, is_first, 0, requests from (
  select regexp_replace(name, '\\.[^.]*$', '') as stem, '.' || any_value(ext) as ext, count(*) as requests,
    cast(regexp_extract(name, '[0-9]+') as int) % 2 = 0 as is_first from files_li group by name)"""))
def _(spark, sf_dir):
    """Beside each name an entry that is called like its second slot, and comes before or behind the others."""
    files = view(spark, sf_dir, "files_li").select("path", "name", "ext")
    stem, number = F.regexp_replace("name", "[.][^.]*$", ""), F.regexp_extract("name", "([0-9]+)", 1).cast("int")
    slots = files.select("name", "ext").distinct().select(
        F.concat(F.when(number % 2 == 0, F.lit("/A/")).otherwise(F.lit("/z/")), "name").alias("path"),
        F.concat(stem, F.lit(" (2)."), "ext").alias("name"))
    entries = files.select("path", "name").unionByName(slots).withColumn("src_path", F.col("path"))
    return resolve_flat_names(entries, spark.createDataFrame([], "name string"), ["path"]).select("path", "dst_name")


@query("protected_paths", using("files_pg", """
select page_id, case when path like '%/en/%' then 'protected folder' end as why_file,
  'volume root' as why_volume from (select page_id, path, drive_name from files_pg)"""))
def _(spark, sf_dir):
    pages = view(spark, sf_dir, "files_pg")
    volume = F.concat(F.lit("/Volumes/"), F.substring_index(F.substring_index("path", "/", 3), "/", -1))
    return pages.select(
        "page_id",
        F.when(F.contains("path", F.lit("/en/")), preflight.protected_path("path", ["/Volumes"]))
        .otherwise(preflight.protected_path("path")).alias("why_file"),
        preflight.protected_path(volume).alias("why_volume"))


# ------------------------------------------------------------------ trash log

_LOG = """select src_path as path, event_id, at_ms, size, drive_name,
  case when status = 'copied' then 'trashed' when status = 'skipped-exists' then 'trashed'
       when status = 'source-missing' then 'restored' else 'deleted' end as status,
  status = 'skipped-exists' as is_live, drive_name in ('E0', 'E1') as is_mounted,
  at_ms >= {limit} as is_kept
from outcomes_ev"""
_LIMIT = NOW_MS - 30 * 24 * 3600 * 1000
_OUTCOME = """select *, case when not is_kept then 'pruned' when status = 'restored' then 'acknowledged' when status = 'deleted' then 'deleted'
  when not is_mounted then status when is_live then 'restored' else 'deleted' end as outcome from log"""


def trash_parts(spark, sf_dir):
    events = view(spark, sf_dir, "outcomes_ev")
    seen = F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    status = F.when(F.col("status").isin("copied", "skipped-exists"), "trashed").when(
        F.col("status") == "source-missing", "restored").otherwise("deleted")
    entries = events.select(F.col("src_path").alias("path"), seen.alias("queued_at"), status.alias("status"))
    inventory = events.select(F.col("src_path").alias("path"), "size")
    live = events.filter("status = 'skipped-exists'").select(F.col("src_path").alias("path"))
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    mounts = region.filter("r_regionkey < 2").select(F.concat(F.lit("/Volumes/E"), F.col("r_regionkey").cast("string")).alias("path"))
    return trash.TrashLog(entries, "30d"), inventory, live, mounts


def _reconciled(spark, sf_dir):
    log, inventory, live, mounts = trash_parts(spark, sf_dir)
    return trash.reconcile_trash(log, inventory, live, mounts, NOW_MS), inventory


def _trash_sql(body):
    return using("outcomes_ev", body, log=_LOG.format(limit=_LIMIT), checked=_OUTCOME)


@query("trash_log_after", _trash_sql("""
select path, outcome as status from checked where outcome not in ('pruned', 'deleted', 'acknowledged')"""))
def _(spark, sf_dir):
    return _reconciled(spark, sf_dir)[0].log.entries.select("path", "status")


@query("trash_inventory_after", _trash_sql("select path, size from checked where outcome <> 'deleted'"))
def _(spark, sf_dir):
    return _reconciled(spark, sf_dir)[0].inventory.select("path", "size")


@query("trash_report", _trash_sql("""
select count(*) filter (outcome <> 'pruned') as checked, count(*) filter (outcome = 'restored') as restored,
  count(*) filter (outcome = 'acknowledged') as restored_acked, count(*) filter (outcome = 'pruned') as retention_pruned,
  count(*) filter (outcome = 'trashed') as still_pending, count(*) filter (outcome = 'deleted') as removed from checked"""))
def _(spark, sf_dir):
    done, inventory = _reconciled(spark, sf_dir)
    return done.report(inventory)


@query("trash_retention", using("outcomes_ev", f"""
select src_path as path from outcomes_ev where at_ms >= {NOW_MS - 24 * 3600 * 1000}"""))
def _(spark, sf_dir):
    log = trash_parts(spark, sf_dir)[0]
    return trash.apply_retention(log, NOW_MS, label="24h").entries.select("path")


@query("trash_append", using("outcomes_ev files_pg", """
select src_path as path, case when status in ('copied', 'skipped-exists') then 'trashed'
  when status = 'source-missing' then 'restored' else 'deleted' end as status from outcomes_ev
union all select path, 'trashed' from files_pg"""))
def _(spark, sf_dir):
    log = trash_parts(spark, sf_dir)[0]
    pages = view(spark, sf_dir, "files_pg").select("path", "page_id")
    known = log.entries.select("path", F.lit(0).cast("long").alias("page_id"))
    return trash.trash_append(log, pages.unionByName(known), "2024-01-15T12:00:00.000Z", ["page_id"]).entries.select("path", "status")


@query("folder_own_sizes", using("files_doc", """
select scan_order, root, root || '/' || lang_dir as folder, count(*) as own_files, cast(sum(size) as bigint) as own_bytes
from (select *, array_to_string(string_split(substring(path, length(root) + 2), '/')[1:3], '/') as lang_dir from files_doc)
group by scan_order, root, lang_dir"""))
def _(spark, sf_dir):
    return own_folders(view(spark, sf_dir, "files_doc"), (), "path").select(
        "scan_order", "root", "folder", "own_files", F.col("own_bytes").cast("long").alias("own_bytes"))
