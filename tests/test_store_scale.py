"""What stored plans, scans and diffs read, sort and shuffle."""

import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.operators import diff
from stowage.plans import build
from stowage.sources import inventory, plan_store

SCHEMA = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType())])
LINES = ['{"s":"x","n":1}', '{"s":5,"n":"12"}', '{"s":1.50,"n":1.7}', '{"s":true,"n":"z"}', '{"s":null,"n":1e3,"d":3}',
         '{"s":{"q":1},"n":[1]}', "[1,2]", "7", "null", "{}", '{"S":"x","N":1}', '{"n":99999999999999999999,"d":"1.5"}']


def test_fields_of_a_line_in_one_pass(make):
    parsed = make([(n, line) for n, line in enumerate(LINES)], "id long, value string").select(
        "id", F.try_parse_json("value").alias("_json"))
    each = parsed.select("id", *inventory._variant_fields("_json", SCHEMA)).orderBy("id").collect()
    once = inventory._with_fields(parsed, "_json", SCHEMA)
    assert once.columns == ["s", "n", "d", "id"]
    assert once.select("id", *SCHEMA.names).orderBy("id").collect() == each
    assert once._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") == 1


def test_places_are_given_without_reading_the_plan_twice(spark, make):
    folder = tempfile.mkdtemp(dir="/tmp")
    rows = [("/a", 5), ("/b", None), ("/c", 2), ("/d", None)]
    entries = make(rows, "src_path string, ord long").coalesce(1)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("placed", "")
    plan_store.write_placed(entries.filter("ord is not null"), f"{folder}/old")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("placed")) == 1
    plan_store.write_placed(entries, f"{folder}/new")
    got = {r.src_path: r.ord for r in plan_store.read_entries(spark, f"{folder}/new").collect()}
    assert (got["/a"], got["/c"]) == (5, 2) and 5 < got["/b"] < got["/d"]
    plan_store.write_placed(make([("/x",), ("/y",)], "src_path string").coalesce(1), f"{folder}/none")
    assert [r.src_path for r in plan_store.read_entries(spark, f"{folder}/none").orderBy("ord").collect()] == ["/x", "/y"]


def test_kept_entries_are_whole(make):
    rows = [("/Volumes/D/a/x.txt", "D", "D/a/x.txt", 1, "txt", "1::x.txt::txt"), (None, None, "p", None, None, None)]
    entries = make(rows, "src_path string, drive_name string, dst_rel_path string, size long, ext string, dupe_key string")
    kept = build.kept(entries)
    assert kept.columns == entries.columns and {tuple(r) for r in kept.collect()} == set(rows)


def test_scans_meet_in_one_shuffle_each(spark, make):
    fields = "path string, name string, ext string, size long, mtime long, ord long"
    old = make([("/a", "a", "", 1, 1, 0), ("/a", "a", "", 9, 9, 1), (None, None, None, 1, 1, 2), ("/g", "g", "", 3, 3, 3)], fields)
    new = make([("/a", "a", "", 2, 1, 0), (None, None, None, 1, 1, 1), ("/n", "n", "", 4, 4, 2)], fields)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = diff.scan_diff(old, new, moves=False)
        got = {(r.change, r.path, r.old_path, r.old_size, r.size) for r in rows.collect()}
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == {("changed", "/a", "/a", 1, 2), ("removed", "/g", "/g", 3, None), ("added", "/n", None, None, 4)}
    assert plan.count("Exchange hashpartitioning") == 2


def test_written_scans_are_compressed(spark, make):
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    from registered.stored import written_scans

    folder = tempfile.mkdtemp(dir="/tmp")
    from datetime import datetime
    cols = {"l_orderkey": [1, 2], "l_partkey": [3, 4], "l_suppkey": [5, 6], "l_linenumber": [1, 1], "l_quantity": [4.0, 7.0],
            "l_returnflag": ["A", "N"], "l_shipdate": [datetime(2020, 1, 1)] * 2}
    pq.write_table(pa.table(cols), f"{folder}/lineitem.parquet")
    headers = written_scans(spark, folder)
    base = headers[0].rsplit("/", 1)[0]
    found = [f for kind in ("records", "errors") for f in glob.glob(f"{base}/{kind}/*/part-*")]
    assert found and all(f.endswith(".txt.gz") for f in found)
    files, sources, _ = inventory.read_scans(spark, headers)
    assert {(r.scan_order, r.ord) for r in files.collect()} == {(1, 0), (2, 0)}
    assert [r.error for r in inventory.read_errors(spark, sources).collect()] == ["EACCES"]
