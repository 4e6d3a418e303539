"""Queries that compare scans, drives and contents, and export what a filter leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered.base import query, using
from registered.files import CATEGORY_SQL
from stowage.inventory_views import view
from stowage.operators import dedup, diff, drives, filters
from stowage.session import work_dir
from stowage.sources import export

# Of each order line 1 goes, line 2 grows, line 3 comes and line 4 moves.
_SCANS = {
    "numbered": "select *, regexp_extract(path, '/l([0-9]+)/', 1) as line from files_li",
    "before": "select * from numbered where line <> '3'",
    "after": """select case when line = '4' then replace(path, '/orders/', '/archive/') else path end as path, name, ext, mtime,
  case when line = '2' then size + 1 else size end as size from numbered where line <> '1'""",
    "joined": """select o.path as old_path, n.path as path, o.size as old_size, n.size as size, o.mtime as old_mtime, n.mtime as mtime,
  coalesce(o.name, n.name) as name, coalesce(o.ext, n.ext) as ext from before o full join after n on o.path = n.path""",
    "lost": """select old_path, name, ext, old_size as size, old_mtime as mtime,
  row_number() over (partition by old_size, name, ext, old_mtime order by old_path) as n from joined where path is null""",
    "found": """select path, name, ext, size, mtime,
  row_number() over (partition by size, name, ext, mtime order by path) as n from joined where old_path is null""",
    "moved": "select f.path, l.old_path, f.size, f.mtime from found f join lost l using (size, name, ext, mtime, n)",
    "diff": """
select 'changed' as change, path, old_path, old_size, size, old_mtime, mtime from joined
  where path = old_path and (size <> old_size or mtime <> old_mtime)
union all select 'moved', path, old_path, size, size, mtime, mtime from moved
union all select 'removed', old_path, old_path, old_size, null, old_mtime, null from joined
  where path is null and old_path not in (select old_path from moved)
union all select 'added', path, null, null, size, null, mtime from joined
  where old_path is null and path not in (select path from moved)""",
}


def _scans(spark, sf_dir):
    line = F.regexp_extract("path", "/l([0-9]+)/", 1)
    files = view(spark, sf_dir, "files_li").withColumn("line", line)
    moved = F.when(F.col("line") == "4", F.replace(F.col("path"), F.lit("/orders/"), F.lit("/archive/")))
    after = files.filter("line <> '1'").withColumn("path", F.coalesce(moved, "path")).withColumn(
        "size", F.col("size") + (F.col("line") == "2").cast("int"))
    return files.filter("line <> '3'"), after


@query("scan_diff", using("files_li", "select * from diff", **_SCANS))
def _(spark, sf_dir):
    return diff.scan_diff(*_scans(spark, sf_dir), "path")


@query("scan_diff_totals", using("files_li", """
select change, count(*) as files, cast(sum(case when change = 'removed' then old_size else size end) as bigint) as bytes
from diff group by change""", **_SCANS))
def _(spark, sf_dir):
    return diff.diff_totals(diff.scan_diff(*_scans(spark, sf_dir), "path"))


@query("drive_pairs", using("files_li", """
select a.drive_name as drive_a, b.drive_name as drive_b, count(*) as shared_keys, cast(sum(size) as bigint) as shared_bytes
from held a join held b using (size, name, ext) where a.drive_name < b.drive_name group by all""",
    held="select distinct size, name, ext, drive_name from files_li"))
def _(spark, sf_dir):
    return drives.drive_pairs(view(spark, sf_dir, "files_li"))


@query("drive_sets", using("files_li", """
select drives, count(*) as shared_keys, cast(sum(size) as bigint) as shared_bytes from (
  select size, string_agg(distinct drive_name, '+' order by drive_name) as drives, count(distinct drive_name) as n
  from files_li group by size, name, ext) where n > 1 group by drives"""))
def _(spark, sf_dir):
    return drives.drive_sets(view(spark, sf_dir, "files_li")).withColumn("drives", F.array_join("drives.drive", "+"))


def _renamed(spark, sf_dir):
    """The documents as files that are all called after their language, with their contents."""
    files = view(spark, sf_dir, "files_doc").withColumn("name", F.concat(F.split_part("path", F.lit("/"), F.lit(4)), F.lit(".txt")))
    number = F.split_part("path", F.lit("/"), F.lit(6)).cast("long").alias("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    contents = files.select("path", number).join(docs, "doc_id").select("path", "content")
    return files, contents


def _content_sql(key: str) -> str:
    return using("files_doc", f"""
select path, content_hash, row_number() over w = 1 as is_winner, first_value(path) over w as winner_path
from (select *, count(*) over (partition by {key}, content_hash) as n from (
  select f.path, scan_order, size, split_part(path, '/', 4) as name, sha256(text) as content_hash
  from files_doc f join documents d on d.doc_id = cast(split_part(path, '/', 6) as bigint)))
where n > 1 window w as (partition by {key}, content_hash order by scan_order, path)""")


@query("dedupe_by_content", _content_sql("size, name"))
def _(spark, sf_dir):
    files, contents = _renamed(spark, sf_dir)
    return dedup.dedupe_by_content(files, contents, ("scan_order", "path")).select(
        "path", "content_hash", "is_winner", "winner_path")


@query("dedupe_by_content_any_name", _content_sql("size"))
def _(spark, sf_dir):
    files, contents = _renamed(spark, sf_dir)
    return dedup.dedupe_by_content(files, contents, ("scan_order", "path"), by=("size",)).select(
        "path", "content_hash", "is_winner", "winner_path")


def _exported(spark, sf_dir, kind):
    files = view(spark, sf_dir, "files_li").select("name", "path", "size", "mtime", "ext")
    path = f"{work_dir(spark)}/stowage/export-{uuid.uuid4().hex}"
    spec = filters.FilterSpec(category="video", min_size=2)
    export.export_filtered(files, spec, path, ["mtime", "path"], kind, rows_per_file=500)
    return export.read_export(spark, path, files.schema, kind)


_EXPORT = using("files_li", f"""
select name, path, size, mtime, ext, row_number() over (order by mtime, path) - 1 as position
from files_li where {CATEGORY_SQL} = 'video' and size >= 2""")


@query("export_filtered", _EXPORT)
def _(spark, sf_dir):
    return _exported(spark, sf_dir, "csv")


@query("export_filtered_json", _EXPORT)
def _(spark, sf_dir):
    return _exported(spark, sf_dir, "json")
