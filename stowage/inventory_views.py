"""Inventories derived from the given tables.

Each view is one SQL text. Two parts differ between engines: ``{ms:column}``,
the epoch milliseconds of a zone-less timestamp, and ``{copies}``, which
repeats a row for three drives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_EXT = "case l_returnflag when 'A' then 'jpg' when 'N' then 'mp4' else 'pdf' end"

VIEWS = {
    "files_li": ("lineitem", f"""
select cast(l_suppkey % 4 as int) as scan_order,
  concat('D', cast(l_suppkey % 4 as string)) as drive_name,
  concat('/Volumes/D', cast(l_suppkey % 4 as string)) as root,
  concat('part_', cast(l_partkey as string), '.', {_EXT}) as name,
  concat('/Volumes/D', cast(l_suppkey % 4 as string), '/orders/o', cast(l_orderkey as string),
         '/s', cast(l_suppkey as string), '/l', cast(l_linenumber as string),
         '/part_', cast(l_partkey as string), '.', {_EXT}) as path,
  cast(l_quantity as bigint) % 5 as size, {{ms:l_shipdate}} as mtime, {_EXT} as ext
from lineitem"""),
    "files_proj": ("lineitem", f"""
select c.c as scan_order, concat('C', cast(c.c as string)) as drive_name,
  concat('/Volumes/C', cast(c.c as string)) as root,
  concat('part_', cast(l_partkey as string), '_', cast(l_orderkey as string), '_',
         cast(l_suppkey as string), '.', {_EXT}) as name,
  concat('/Volumes/C', cast(c.c as string), '/work/p', cast(l_orderkey % 400 as string), '/',
         case l_linenumber when 6 then 'node_modules' when 7 then 'src' else 'img' end,
         '/l', cast(l_linenumber as string), '/part_', cast(l_partkey as string), '_',
         cast(l_orderkey as string), '_', cast(l_suppkey as string), '.', {_EXT}) as path,
  cast(l_quantity as bigint) as size, {{ms:l_shipdate}} as mtime, {_EXT} as ext
from lineitem {{copies}}
where c.c = 0 or (c.c = 1 and (l_orderkey + l_partkey) % 10 <> 0)
   or (c.c = 2 and l_partkey % 20 <> 0)"""),
    # Near copies of one folder, a thirty-second as many as there are orders; about half of them equal.
    "files_ord": ("orders", """
select cast(floor(o_orderkey / 32) % 3 as int) as scan_order,
  concat('B', cast(cast(floor(o_orderkey / 32) % 3 as int) as string)) as drive_name,
  concat('/Volumes/B', cast(cast(floor(o_orderkey / 32) % 3 as int) as string)) as root,
  concat(case when o_custkey % 40 = 0 then concat('own_', cast(o_orderkey as string))
         else concat('part_', cast(o_orderkey % 32 as string)) end, '.jpg') as name,
  concat('/Volumes/B', cast(cast(floor(o_orderkey / 32) % 3 as int) as string), '/work/p',
         cast(cast(floor(o_orderkey / 32) as bigint) as string), '/img/',
         case when o_custkey % 40 = 0 then concat('own_', cast(o_orderkey as string))
         else concat('part_', cast(o_orderkey % 32 as string)) end, '.jpg') as path,
  cast(o_orderkey % 32 as bigint) as size, {ms:o_orderdate} as mtime, 'jpg' as ext
from orders"""),
    "files_doc": ("documents", """
select cast(substring(source, 4) as int) as scan_order, source as drive_name,
  concat('/Volumes/', source) as root, concat(md5(text), '.txt') as name,
  concat('/Volumes/', source, '/', lang, '/d', cast(doc_id % 10 as string), '/',
         cast(doc_id as string), '/', md5(text), '.txt') as path,
  n_chars as size, cast(1700000000000 + doc_id * 60000 as bigint) as mtime, 'txt' as ext
from documents"""),
    "files_pg": ("pages", """
select page_id, split_part(split_part(url, '/', 3), '?', 1) as drive_name,
  concat('/Volumes/', split_part(url, '/', 3), '/',
         split_part(split_part(split_part(url, '/', 4), '?', 1), '#', 1),
         '/p', cast(page_id as string), '.html') as path,
  cast(length(html) as bigint) as size
from pages"""),
    "outcomes_ev": ("events", """
select event_id, concat('/Volumes/E', cast(user_id % 4 as string), '/f', cast(event_id as string)) as src_path,
  concat('E', cast(user_id % 4 as string)) as drive_name, {ms:ts} as at_ms,
  case event_type when 'click' then 'copied' when 'view' then 'copied'
    when 'purchase' then 'skipped-exists' when 'signup' then 'source-missing' else 'failed' end as status,
  cast(floor(value * 100) as bigint) as size
from events"""),
}


def _expand(name: str, ms: str, copies: str) -> str:
    sql = VIEWS[name][1].replace("{copies}", copies)
    return re.sub(r"\{ms:(\w+)\}", lambda found: ms.format(c=found[1]), sql)


def spark_text(name: str) -> str:
    # Built from date parts, so that the session time zone has no say.
    return _expand(name, (
        "(cast(unix_date(cast({c} as date)) as bigint) * 86400000 + hour({c}) * 3600000"
        " + minute({c}) * 60000 + cast(floor(extract(second from {c}) * 1000) as bigint))"),
        "lateral view explode(array(0, 1, 2)) c as c")


def duckdb_text(name: str) -> str:
    if name == "files_all":
        return f"select * from ({duckdb_text('files_proj')}) union all by name " \
               f"select * replace (cast(scan_order + 3 as int) as scan_order) from ({duckdb_text('files_li')})"
    return _expand(name, "cast(epoch_us({c}) // 1000 as bigint)", ", unnest([0, 1, 2]) as c(c)")


def _spread(source: DataFrame) -> DataFrame:
    """Use all cores on a table that is stored in fewer splits than there are cores."""
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(cores) if source.rdd.getNumPartitions() < cores else source


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "files_all":
        loose = view(spark, sf_dir, "files_li")
        return view(spark, sf_dir, "files_proj").unionByName(loose.withColumn("scan_order", loose.scan_order + 3))
    table = VIEWS[name][0]
    source = _spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return spark.sql(spark_text(name).replace(f"from {table}", "from {source}"), source=source)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view over a stream of the table's files."""
    table = VIEWS[name][0]
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return spark.sql(spark_text(name).replace(f"from {table}", "from {source}"), source=source)
