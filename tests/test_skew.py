"""Hot groups must give the same rows as ordinary ones."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import dedup, skew
from stowage.plans import build


@pytest.fixture
def files(spark):
    rng = random.Random(7)
    rows = []
    for n in range(300):
        hot = rng.random() < 0.35
        name = ".DS_Store" if hot else f"f{rng.randint(0, 40)}.txt"
        rows.append((rng.randint(0, 2), n, name, f"/Volumes/D/{'x' * rng.randint(1, 9)}/{n}/{name}",
                     6148 if hot else rng.randint(0, 1), rng.randint(0, 5), None if hot else "txt"))
    return spark.createDataFrame(
        rows, "scan_order int, ord long, name string, path string, size long, mtime long, ext string")


@pytest.mark.parametrize("mode", dedup.TIE_BREAKS)
def test_dedupe_matches_a_plain_loop(files, mode):
    value = {"newest": lambda r: -r.mtime, "oldest": lambda r: r.mtime, "shortestPath": lambda r: len(r.path)}.get(
        mode, lambda r: 0)
    groups = {}
    for r in sorted(files.collect(), key=lambda r: (r.scan_order, r.ord)):
        groups.setdefault((r.size, r.name, r.ext or ""), []).append(r)
    want = {}
    for rows in groups.values():
        best = min(rows, key=lambda r: (value(r), r.scan_order, r.ord))
        want.update({r.path: (r is best, best.path) for r in rows})
    got = {r.path: (r.is_winner, r.winner_path) for r in dedup.dedupe_files(files, mode).collect()}
    assert got == want


def test_a_hot_key_is_split_while_the_query_runs(spark):
    lowered = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
               "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in lowered}
    try:
        for k, v in lowered.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 120_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id",
            F.sha2(F.col("id").cast("string"), 256).alias("text"))
        marked = skew.pick_first(rows, ["k"], [F.col("id")], {"first": F.col("text")})
        marked.write.format("noop").mode("overwrite").save()
        assert marked.filter("is_winner").count() == 80_001 and marked.count() == 120_000
        done = marked.select("first", "is_winner", "text")
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_count_over_ranges(files):
    from pyspark.sql import Window

    flag = F.col("size") > 0
    whole = Window.partitionBy("name").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    plain = files.withColumn("n", F.sum(F.when(flag, 1).otherwise(0)).over(whole)).collect()
    cut = skew.running_count(files, "name", ["ord"], flag, "n").collect()
    assert sorted(map(str, plain)) == sorted(map(str, cut))


def test_with_group_keeps_null_keys(files):
    got = skew.with_group(files, ["name", "ext"], {"n": F.count("*"), "lo": F.min("ord")}).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.name, r.ext), []).append(r)
    assert len(got) == 300
    assert all(r.n == len(g) and r.lo == min(x.ord for x in g) for g in groups.values() for r in g)


def test_project_winner_with_hot_component(spark):
    projects = spark.createDataFrame(
        [(f"0::/r/p{i:03d}", "id", 0, "D", "/r", f"/r/p{i:03d}", 2, 5, 100 - i, i, "r", "R", "c") for i in range(60)],
        "project_key string, project_id string, scan_order int, drive_name string, root string, folder string, depth int,"
        "file_count long, total_bytes long, first_ord long, rule_id string, rule_name string, rule_color string")
    groups = projects.select("project_key", F.lit("g").alias("component"))
    for mode in dedup.TIE_BREAKS:
        kept = build.choose_projects(projects, groups, mode).filter("is_winner").collect()
        assert [r.folder for r in kept] == [{"oldest": "/r/p059"}.get(mode, "/r/p000")]


def test_places_of_one_key_fill_several_tasks(spark):
    # Places of two ranges and more apart, far from zero too; keys may be null.
    rows = [(k, n * step + 1, n) for k, step in (("a", 9_000), ("b", 1), (None, 1 << 33)) for n in range(40)]
    df = spark.createDataFrame(rows, "k string, ord long, n long").repartition(5, "n")
    placed = skew.place_among(df, "k", "ord", "place")
    assert placed.columns == ["k", "ord", "n", "place"]
    assert {(r.k, r.n): r.place for r in placed.collect()} == {(k, n): n + 1 for k, _, n in rows}
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tasks = placed.filter("k is null").select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert tasks > 1


def test_the_kept_path_is_shuffled_once(files):
    marked = dedup.dedupe_files(files, "newest", ("scan_order", "path"))
    groups = {}
    for r in files.collect():
        groups.setdefault((r.size, r.name, r.ext or ""), []).append(r)
    best = {k: min(rows, key=lambda r: (-r.mtime, r.scan_order, r.path)).path for k, rows in groups.items()}
    got = {r.path: (r.is_winner, r.winner_path) for r in marked.collect()}
    assert got == {r.path: (best[r.size, r.name, r.ext or ""] == r.path, best[r.size, r.name, r.ext or ""])
                   for r in files.collect()}
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "AS winner_path" in plan and ", winner_path, path" not in plan
