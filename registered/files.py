"""Queries over single inventories: columns, filters, breakdowns, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import NOW_LI_MS, query, using
from stowage.functions import buckets, names
from stowage.functions.globs import glob_match
from stowage.inventory_views import view
from stowage.operators import dedup, filters, reports

SEEN = ("scan_order", "path")

CATEGORY_SQL = """case when ext in ('jpg','png') then 'image' when ext = 'mp4' then 'video'
  when ext in ('pdf','txt') then 'document' else 'other' end"""


def age_sql(now_ms: int, column: str = "mtime") -> str:
    now = f"make_timestamp({now_ms} * 1000)"
    def since(unit):
        return f"{column} >= epoch_ms(date_trunc('{unit}', {now}))"
    return (f"case when {since('day')} then 'today' when {since('week')} then 'this-week' "
            f"when {since('month')} then 'this-month' when {since('year')} then 'this-year' "
            f"when {column} >= epoch_ms({now} - interval 5 years) then 'older' else 'ancient' end")


# ---------------------------------------------------------------- duplicates

_METRIC = {
    "firstScanned": "scan_order", "newest": "mtime desc, scan_order", "oldest": "mtime, scan_order",
    "shortestPath": "length(path), scan_order", "largest": "size desc, scan_order",
}


def _dedupe_sql(source: str, mode: str, columns: str) -> str:
    return using(source, f"""
select {columns}, rn = 1 as is_winner, winner_path from (
  select *, row_number() over w as rn, first_value(path) over w as winner_path from {source}
  window w as (partition by size, name, ext order by {_METRIC[mode]}, path))""")


def _register_dedupe(suffix: str, source: str, mode: str, columns: list[str]):
    @query(f"dedupe_{suffix}", _dedupe_sql(source, mode, ", ".join(columns)))
    def run(spark, sf_dir):
        marked = dedup.dedupe_files(view(spark, sf_dir, source), mode, SEEN)
        return marked.select(*columns, "is_winner", "winner_path")


for _suffix, _mode in (("first_scanned", "firstScanned"), ("newest", "newest"), ("oldest", "oldest"),
                       ("shortest_path", "shortestPath"), ("largest", "largest")):
    _register_dedupe(_suffix, "files_li", _mode, ["drive_name", "path", "size", "ext"])
_register_dedupe("documents_newest", "files_doc", "newest", ["drive_name", "path", "size", "ext"])
_register_dedupe("documents_shortest_path", "files_doc", "shortestPath", ["drive_name", "path", "size", "ext"])


@query("dedupe_winners_oldest", using("files_li", """
select path, size, mtime from files_li
qualify row_number() over (partition by size, name, ext order by mtime, scan_order, path) = 1"""))
def _(spark, sf_dir):
    return dedup.dedupe_winners(view(spark, sf_dir, "files_li"), "oldest", SEEN).select("path", "size", "mtime")


@query("only_duplicates", using("files_li", """
select path, copies from (select path, count(*) over (partition by size, name, ext) as copies from files_li)
where copies > 1"""))
def _(spark, sf_dir):
    return dedup.only_duplicates(view(spark, sf_dir, "files_li")).select("path", "copies")


@query("hide_duplicates", using("files_li", """
select path, size from files_li
qualify row_number() over (partition by size, name, ext order by length(path), path) = 1"""))
def _(spark, sf_dir):
    return dedup.hide_duplicates(view(spark, sf_dir, "files_li")).select("path", "size")


@query("duplicate_summary", using("files_doc", """
select count(*) as groups, cast(coalesce(sum(n - 1), 0) as bigint) as extra_copies,
  cast(coalesce(sum((n - 1) * size), 0) as bigint) as reclaimable_bytes
from (select size, count(*) as n from files_doc group by size, name, ext having count(*) > 1)"""))
def _(spark, sf_dir):
    return reports.duplicate_summary(view(spark, sf_dir, "files_doc"))


@query("first_in_batch", using("outcomes_ev", """
select src_path, status, size from outcomes_ev
qualify row_number() over (partition by drive_name, status order by event_id) = 1"""))
def _(spark, sf_dir):
    events = view(spark, sf_dir, "outcomes_ev").withColumn("batch_key", F.concat_ws("/", "drive_name", "status"))
    return dedup.first_in_batch(events, "batch_key", ["event_id"]).select("src_path", "status", "size")


@query("last_in_batch", using("outcomes_ev", """
select drive_name, status, max(event_id) as event_id, min(event_id) as position
from outcomes_ev group by drive_name, status"""))
def _(spark, sf_dir):
    last = dedup.last_in_batch(view(spark, sf_dir, "outcomes_ev"), ["drive_name", "status"], ["event_id"])
    return last.select("drive_name", "status", "event_id", F.col("position.event_id").alias("position"))


# ------------------------------------------------------------------- columns

@query("path_columns", using("files_li", r"""
select path,
  regexp_extract(lower(name), '(?s)^.+\.([^.]*)$', 1) as ext2,
  cast(size as varchar) || '::' || name || '::' || ext as dupe_key,
  drive_name || '/' || substring(path, length(root) + 2) as mirrored,
  name as flat,
  6 as depth,
  root || '/orders' as top_folder,
  root as volume,
  cast(length(path) as int) as units,
  substring(path, length(root) + 2) as rel
from files_li"""))
def _(spark, sf_dir):
    files = view(spark, sf_dir, "files_li").select("name", "path", "size", "ext", "root", "drive_name")
    return files.select(
        "path", names.file_ext("name").alias("ext2"), names.dupe_key().alias("dupe_key"),
        names.mirrored_dst("drive_name", "path", "root").alias("mirrored"), names.flat_dst("path").alias("flat"),
        (names.path_depth("path") - 1).alias("depth"), names.top_folder("path").alias("top_folder"),
        names.volume_of("path").alias("volume"), names.utf16_length("path").alias("units"),
        names.rel_path("path", "root").alias("rel"),
    )


@query("ancestor_folders", using("files_pg", """
select page_id, '/Volumes/' || f as folder, cast(i as int) as level from (
  select page_id, i, array_to_string(segs[1:i], '/') as f
  from (select page_id, list_filter(string_split(substring(path, 10), '/'), lambda x: x <> '') as segs from files_pg),
       generate_series(1, len(segs) - 1) as g(i))"""))
def _(spark, sf_dir):
    pages = view(spark, sf_dir, "files_pg").withColumn("root", F.lit("/Volumes"))
    return pages.select("page_id", F.posexplode(names.ancestors("path", "root")).alias("n", "folder")).select(
        "page_id", "folder", (F.col("n") + 1).alias("level"))


@query("sanitized_names", r"""
select page_id, coalesce(nullif(trim(regexp_replace(url, '[/\\:*?"<>|]+', '_', 'g')), ''), 'unknown') as safe
from pages""")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", names.sanitize_for_path("url").alias("safe"))


@query("file_classes", using("files_li", f"""
select path, {CATEGORY_SQL} as category, {age_sql(NOW_LI_MS)} as age,
  cast(floor(log2(greatest(size, 1)) + 0.5) as int) as bucket from files_li"""))
def _(spark, sf_dir):
    return view(spark, sf_dir, "files_li").select(
        "path", buckets.category().alias("category"), buckets.age_bucket("mtime", NOW_LI_MS).alias("age"),
        buckets.size_bucket("size").alias("bucket"))


@query("glob_matches", r"""
select p_partkey, regexp_full_match(lower(p_name), '[^/]*[^/]') as any_name,
  regexp_full_match(lower(p_type), 'std[^/]*') as std_type,
  regexp_full_match(lower(p_brand), 'brand#1[^/]') as brand_1x,
  regexp_full_match(lower(p_brand), '(?:brand#1[^/]*|brand#21)') as brand_alt
from part""")
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        "p_partkey", glob_match("p_name", "*?").alias("any_name"), glob_match("p_type", "STD*").alias("std_type"),
        glob_match("p_brand", "brand#1?").alias("brand_1x"),
        glob_match("p_brand", "{Brand#1*, brand#21}").alias("brand_alt"))


# ------------------------------------------------------------------- filters

@query("filter_size_ext_date", using("files_li", """
select path, size, mtime from files_li
where size >= 2 and size <= 4 and ext in ('jpg', 'pdf')
  and mtime >= 820454400000 and mtime <= 915148800000"""))
def _(spark, sf_dir):
    spec = filters.FilterSpec(min_size="2b", max_size=4, extensions=["JPG", ".pdf"],
                              modified_after=820454400000, modified_before=915148800000)
    return filters.filter_inventory(view(spark, sf_dir, "files_li"), spec).select("path", "size", "mtime")


@query("filter_text_age_category", using("files_li", f"""
select path from files_li where contains(lower(name), '_1') and contains(lower(path), '/volumes/d2/')
  and starts_with(path, '/Volumes/D2/orders/') and {CATEGORY_SQL} = 'video' and {age_sql(NOW_LI_MS)} = 'older'
  and len(list_filter(string_split(path, '/'), lambda x: x <> '')) between 4 and 9"""))
def _(spark, sf_dir):
    spec = filters.FilterSpec(name_contains="_1", path_contains="/volumes/D2/", top_folder="/Volumes/D2/orders",
                              category="video", age="older", min_depth=4, max_depth=9)
    return filters.filter_inventory(view(spark, sf_dir, "files_li"), spec, NOW_LI_MS).select("path")


@query("filter_then_only_duplicates", using("files_li", """
select path from (select path, count(*) over (partition by size, name, ext) as n from files_li where size >= 3)
where n > 1"""))
def _(spark, sf_dir):
    spec = filters.FilterSpec(min_size=3, duplicates="only")
    return filters.filter_inventory(view(spark, sf_dir, "files_li"), spec).select("path")


@query("filter_then_hide_duplicates", using("files_doc", """
select path from files_doc where size <= 2000
qualify row_number() over (partition by size, name, ext order by length(path), path) = 1"""))
def _(spark, sf_dir):
    spec = filters.FilterSpec(max_size="2kb", duplicates="hide")
    return filters.filter_inventory(view(spark, sf_dir, "files_doc"), spec).select("path")


_LISTING_SQL = """
select case when event_type = 'error' then '/Volumes/E/.Spotlight-V100/e' || event_id
            when event_type = 'signup' then '/Volumes/E/Time Machine Backups/e' || event_id
            when event_type = 'view' and user_id % 3 = 0 then '/Volumes/E/v/.Trashes'
            else '/Volumes/E/' || event_type || '/e' || event_id || '.Dat' end as path,
  case when event_type = 'purchase' then 'symlink' else 'file' end as kind,
  cast(floor(value * 100) as bigint) as size, {ms} as mtime_ms, event_id
from {events}"""


@query("listing_to_inventory", f"""
select event_id, path, regexp_extract(path, '[^/]*$') as name, size, mtime_ms as mtime,
  case when path like '%.Dat' then 'dat' else '' end as ext
from ({_LISTING_SQL.format(ms="cast(epoch_us(ts) // 1000 as bigint)", events="events")})
where kind = 'file' and path not like '%/.Spotlight%' and path not like '%/.Trashes'
  and path not like '%/Time Machine Backups/%'""")
def _(spark, sf_dir):
    from stowage.sources.inventory import inventory_from_listing

    listing = view(spark, sf_dir, "outcomes_ev").select("event_id", F.col("at_ms").alias("mtime_ms")).join(
        spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    listing = spark.sql(_LISTING_SQL.format(ms="mtime_ms", events="{listing}"), listing=listing)
    records = inventory_from_listing(
        listing.withColumn("mtime", F.col("mtime_ms").cast("double") + 0.75), "/Volumes/E", keep=["event_id"])
    return records.select("event_id", "path", "name", "size", "mtime", "ext")


# ------------------------------------------------------------------- reports

@query("scan_totals", using("files_li", """
select scan_order, count(*) as file_count, cast(sum(size) as bigint) as total_bytes
from files_li group by scan_order"""))
def _(spark, sf_dir):
    return reports.scan_totals(view(spark, sf_dir, "files_li"))


@query("scan_error_totals", using("outcomes_ev", """
select f.drive_name, f.file_count, f.total_bytes, coalesce(e.n, 0) as error_count, s.first_paths from
  (select drive_name, count(*) as file_count, cast(sum(size) as bigint) as total_bytes
   from outcomes_ev where status <> 'failed' group by drive_name) f
  left join (select drive_name, count(*) as n from outcomes_ev where status = 'failed' group by drive_name) e
    on e.drive_name = f.drive_name
  left join (select drive_name, string_agg(src_path, ',' order by event_id) as first_paths from
     (select *, row_number() over (partition by drive_name order by event_id) as rn
      from outcomes_ev where status = 'failed') where rn <= 50 group by drive_name) s
    on s.drive_name = f.drive_name"""))
def _(spark, sf_dir):
    events = view(spark, sf_dir, "outcomes_ev")
    failed = events.filter("status = 'failed'").select(
        "drive_name", F.col("event_id").alias("ord"), F.col("src_path").alias("path"), F.col("status").alias("error"))
    totals = reports.scan_totals(events.filter("status <> 'failed'"), failed, by="drive_name")
    return totals.select("drive_name", "file_count", "total_bytes", "error_count",
                         F.array_join("errors_sample.path", ",").alias("first_paths"))


@query("breakdown", using("files_li", f"""
select dimension, value, count(*) as files, cast(sum(size) as bigint) as bytes from (
  select 'category' as dimension, {CATEGORY_SQL} as value, size from files_li
  union all select 'age', {age_sql(NOW_LI_MS)}, size from files_li
  union all select 'ext', ext, size from files_li
  union all select 'top_folder', root || '/orders', size from files_li)
group by dimension, value"""))
def _(spark, sf_dir):
    return reports.breakdown(view(spark, sf_dir, "files_li"), NOW_LI_MS)


@query("breakdown_top_extensions", using("files_li", """
select 'ext' as dimension, ext as value, count(*) as files, cast(sum(size) as bigint) as bytes
from files_li group by ext order by bytes desc, value limit 2"""))
def _(spark, sf_dir):
    return reports.top_values(reports.breakdown(view(spark, sf_dir, "files_li"), NOW_LI_MS), "ext", 2)


@query("largest_files", using("files_doc", """
select path, size from files_doc order by size desc, path limit 100"""))
def _(spark, sf_dir):
    return reports.largest_files(view(spark, sf_dir, "files_doc"), 100).select("path", "size")


@query("facets", using("files_li", f"""
select 'top_folder' as facet, root || '/orders' as value, count(*) as files from files_li group by root
union all
select 'ext', ext, count(*) from files_li where {CATEGORY_SQL} = 'image' group by ext"""))
def _(spark, sf_dir):
    return reports.facets(view(spark, sf_dir, "files_li"), "image")


@query("status_counts", using("outcomes_ev", """
select coalesce(status, '(total)') as status, count(*) as entries from outcomes_ev group by rollup (status)"""))
def _(spark, sf_dir):
    return reports.status_counts(view(spark, sf_dir, "outcomes_ev"))


@query("recompute_totals", using("outcomes_ev", """
select count(*) filter (status in ('pending', 'copied')) as total_files,
  cast(coalesce(sum(size) filter (status in ('pending', 'copied')), 0) as bigint) as total_bytes,
  count(*) filter (status = 'skipped-duplicate') as duplicates_collapsed,
  count(*) filter (status = 'source-error') as error_count from outcomes_ev"""))
def _(spark, sf_dir):
    return reports.recompute_totals(view(spark, sf_dir, "outcomes_ev"))


@query("dedupe_one_hot_key", """
with f as (select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then '.DS_Store'
    else 'part_' || l_partkey end as name from lineitem)
select l_orderkey, l_linenumber, name, row_number() over (partition by name order by l_orderkey, l_linenumber) = 1 as is_winner,
  count(*) over (partition by name) as copies from f""")
def _(spark, sf_dir):
    from stowage.operators.skew import pick_first, with_group

    # A third of all rows have one key.
    name = F.when(F.col("l_orderkey") % 3 == 0, ".DS_Store").otherwise(F.concat(F.lit("part_"), "l_partkey"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", name.alias("name"))
    marked = pick_first(rows, ["name"], [F.col("l_orderkey"), F.col("l_linenumber")], {})
    return with_group(marked, ["name"], {"copies": F.count("*")})
