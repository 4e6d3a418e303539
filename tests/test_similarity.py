"""Groups of similar projects against a brute-force comparison of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import similarity
from stowage.operators.components import connected_components
from stowage.session import materialize


def brute(projects, threshold):
    keys = sorted(projects)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            (ra, na, sa), (rb, nb, sb) = projects[a], projects[b]
            if ra != rb or round(math.log2(max(1, na)) + 1e-12) != round(math.log2(max(1, nb)) + 1e-12):
                continue
            union = len(sa | sb)
            if union and len(sa & sb) / union >= threshold:
                pairs.add((a, b))
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return pairs, {k: find(k) for k in keys}


def tables(spark, projects):
    frame = spark.createDataFrame([(k, r, n) for k, (r, n, _) in projects.items()], "project_key string, rule_id string, file_count long")
    items = [(k, i) for k, (_, _, s) in projects.items() for i in s]
    return frame, materialize(spark.createDataFrame(items, "project_key string, item string"))


def family(rng, copies, size, changes, common=()):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(size)]
    for _ in range(copies):
        own = set(base)
        for _ in range(rng.randint(0, changes)):
            own.discard(rng.choice(base))
            if rng.random() < 0.5:
                own.add(f"n{rng.randint(0, 10**6)}")
        yield own | set(common)


def sample(seed):
    rng = random.Random(seed)
    sets = [s for _ in range(5) for s in family(rng, 4, rng.choice([3, 9, 12, 22, 40]), 3, ["init:0"])]
    sets += [set(), set(), {"init:0"}, {"init:0"}]
    return {f"p{i:03d}": (rng.choice("ab") if i > 12 else "a", max(1, len(s)), s) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed,threshold", [(1, 0.9), (2, 0.6), (3, 0.8)])
def test_groups_and_pairs(spark, seed, threshold):
    projects = sample(seed)
    want_pairs, want_groups = brute(projects, threshold)
    frame, items = tables(spark, projects)
    got = similarity.similar_groups(frame, items, threshold)
    assert {r.project_key: r.component for r in got.collect()} == want_groups
    pairs = similarity.similar_pairs(frame, items, threshold)
    assert {(r.a, r.b) for r in pairs.collect()} == want_pairs


def test_crowded_items_go_through_pivots(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIR_GROUP", 3)
    monkeypatch.setattr(similarity, "TILE", 4)
    monkeypatch.setattr(similarity, "PIVOT_ROUNDS", 1)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(8)]
    sets = list(family(rng, 14, 20, 2)) + [set(shared) | {f"o{i}", f"q{i}"} for i in range(12)]
    projects = {f"p{i:03d}": ("a", 16, s) for i, s in enumerate(sets)}
    for threshold in (0.6, 0.85):
        frame, items = tables(spark, projects)
        got = similarity.similar_groups(frame, items, threshold)
        assert {r.project_key: r.component for r in got.collect()} == brute(projects, threshold)[1]


@pytest.mark.parametrize("seed,threshold", [(4, 0.9), (5, 0.7)])
def test_items_in_several_parts(spark, monkeypatch, seed, threshold):
    monkeypatch.setattr(similarity, "PART", 3)
    projects = sample(seed)
    want_pairs, want_groups = brute(projects, threshold)
    frame, items = tables(spark, projects)
    assert {(r.a, r.b) for r in similarity.similar_pairs(frame, items, threshold).collect()} == want_pairs
    assert {r.project_key: r.component for r in similarity.similar_groups(frame, items, threshold).collect()} == want_groups


def test_classes_count_all_links_and_pair_only_representatives(spark):
    projects = sample(7) | {f"z{i}": ("a", 16, {f"e{j}" for j in range(16)}) for i in range(40)}
    projects |= {f"y{i}": ("a", 16, {f"e{j}" for j in range(16)} - {"e3"} | {"own"}) for i in range(3)}
    links = {k: 0 for k in projects}
    want, _ = brute(projects, 0.85)
    for pair in want:
        for k in pair:
            links[k] += 1
    first = {}
    for k, (rule, n, own) in sorted(projects.items()):
        first.setdefault((rule, round(math.log2(max(1, n)) + 1e-12), frozenset(own)) if own else k, k)
    rep = {k: first[(r, round(math.log2(max(1, n)) + 1e-12), frozenset(s)) if s else k] for k, (r, n, s) in projects.items()}
    members, pairs = similarity.similar_classes(*tables(spark, projects), 0.85)
    got = {r.project_key: (r.class_key, r.n_links) for r in members.collect()}
    assert got == {k: (rep[k], links[k]) for k in projects}
    assert {(r.a, r.b) for r in pairs.collect()} == {p for p in want if all(rep[k] == k for k in p)}


def test_hundred_thousand_equal_projects_give_as_many_rows(spark):
    many = spark.range(100_000).select(
        F.format_string("p%06d", "id").alias("project_key"), F.lit("r").alias("rule_id"), F.lit(3).cast("long").alias("file_count"))
    items = materialize(many.select("project_key", F.explode(F.array(*[F.lit(f"i{i}") for i in range(3)])).alias("item")))
    members, pairs = similarity.similar_classes(materialize(many), items)
    row = members.agg(F.count("*").alias("n"), F.countDistinct("class_key").alias("classes"), F.min("n_links").alias("links")).first()
    assert (row.n, row.classes, row.links, pairs.count()) == (100_000, 1, 99_999, 0)


def test_twins_are_decided_by_their_items(spark):
    # Two projects that agree in size and hashes but not in items, as a collision would leave them.
    rows = [("a", 2, 5, 5), ("b", 2, 5, 5), ("c", 2, 5, 5)]
    sigs = materialize(spark.createDataFrame(rows, "project_key string, n long, h1 long, h2 long").withColumn("block", F.lit(0)))
    items = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "y"), ("c", "x")], "project_key string, item string")
    twins = similarity.collapse_equal(sigs, materialize(similarity.item_store(sigs, items)))
    assert {r.project_key: r.twin for r in twins.collect()} == {"a": "a", "b": "b", "c": "a"}


def test_zero_threshold_means_default_and_bucket_edges_block(spark):
    eleven = {f"i{n}" for n in range(11)}
    projects = {"a": ("r", 11, eleven), "b": ("r", 12, eleven | {"x"})}
    frame, items = tables(spark, projects)
    groups = {r.project_key: r.component for r in similarity.similar_groups(frame, items, 0).collect()}
    assert groups == {"a": "a", "b": "b"}
    free = similarity.similar_groups(frame, items, 0, blocking=False)
    assert {r.component for r in free.collect()} == {"a"}


def test_components(spark):
    rng = random.Random(5)
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    star = [("z00", f"z{i:02d}") for i in range(1, 12)]
    extra = [(f"q{rng.randint(0, 9)}", f"q{rng.randint(0, 9)}") for _ in range(6)]
    edges = chain + star + extra
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    parent = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            low = min(parent[a], parent[b])
            parent[a] = parent[b] = low
    table = spark.createDataFrame([(b, a) for a, b in edges], "a string, b string")
    got = connected_components(table, spark.createDataFrame([(n,) for n in nodes], "node string"))
    assert {r.node: r.component for r in got.collect()} == parent


def own_items(spark):
    """Sixty copies of one folder of 32 files, each with one or two files of its own in places of theirs."""
    sets = [{f"i{k}" for k in range(32) if k not in lost} | {f"own{n}_{k}" for k in lost}
            for n, lost in enumerate([{n % 3} for n in range(40)] + [{4, 5 + n % 2} for n in range(20)] + [set(), set()])]
    return {f"p{n:03d}": ("a", 32, s) for n, s in enumerate(sets)}


def test_projects_that_differ_in_items_of_their_own_are_indexed_once(spark):
    projects, items = tables(spark, own_items(spark))
    sigs, store = similarity._prepared(projects, items, True)
    cores, index = similarity._indexed(sigs.filter("project_key = twin and n > 0"), items, store, 0.9)
    assert cores.select("core").distinct().count() == 6
    assert index.select("project_key").distinct().count() <= 6


@pytest.mark.parametrize("tile", [2, 2_000])
def test_links_of_projects_with_items_of_their_own(spark, tile, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", tile)
    sample = own_items(spark)
    want, groups = brute(sample, 0.9)
    projects, items = tables(spark, sample)
    members, pairs = similarity.similar_classes(projects, items, 0.9)
    twins = {("p060", "p061")}
    assert {(r.a, r.b) for r in pairs.collect()} == {p for p in want if "p061" not in p}
    assert pairs.count() == len({p for p in want if "p061" not in p})
    assert {r.project_key: r.n_links for r in members.collect()} == {k: sum(k in p for p in want) for k in sample}
    assert {(r.a, r.b) for r in similarity.similar_pairs(projects, items, 0.9).collect()} == want >= twins
    assert {r.project_key: r.component for r in similarity.similar_groups(projects, items, 0.9).collect()} == groups


def test_an_item_listed_twice_counts_twice(spark):
    # As signature items come from a scan that lists a path twice.
    lists = {"a": ["x", "x", "y"], "b": ["y", "x", "x"], "c": ["x", "y"], "d": ["x", "x", "x", "y"]}
    frame = spark.createDataFrame([(k, "r", 3) for k in lists], "project_key string, rule_id string, file_count long")
    items = materialize(spark.createDataFrame([(k, i) for k, l in lists.items() for i in l], "project_key string, item string"))
    pairs = {(r.a, r.b): round(r.similarity, 6) for r in similarity.similar_pairs(frame, items, 0.5).collect()}
    assert pairs == {("a", "b"): 1.0, ("a", "c"): 0.666667, ("a", "d"): 0.75, ("b", "c"): 0.666667, ("b", "d"): 0.75,
                     ("c", "d"): 0.5}


def test_items_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CODE_BITS", 3)
    lists = {"a": [f"i{n}" for n in range(30)], "b": [f"k{n}" for n in range(30)], "c": [f"i{n}" for n in range(28)] + ["u", "v"]}
    rows = [(k, i) for k, l in lists.items() for i in l]
    codes = similarity.coded(spark.createDataFrame(rows, "project_key string, item string"))
    assert dict(codes.dtypes)["item"] == "bigint"
    assert codes.select("item").distinct().count() == 62
    held = {k: {r.item for r in codes.filter(F.col("project_key") == k).collect()} for k in lists}
    assert (len(held["a"] & held["c"]), len(held["a"] & held["b"])) == (28, 0)


def test_items_that_the_same_projects_hold_are_compared_as_one(spark):
    base = {f"i{n}" for n in range(300)}
    sets = {"a": base, "b": base - {f"i{n}" for n in range(20)}, "c": base - {f"i{n}" for n in range(20, 35)}, "d": {"x", "y"}}
    projects = {k: ("r", 256, s) for k, s in sets.items()}
    frame, items = tables(spark, projects)
    sigs, store = similarity._prepared(frame, items, True)
    assert {r.project_key: r.n for r in sigs.collect()} == {k: len(s) for k, s in sets.items()}
    # 265, 20, 15 and 2 items stand in as many levels as these numbers have bits.
    assert similarity.stored_items(store).groupBy("project_key").count().collect() and similarity.stored_items(store).count() < 25
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.similar_pairs(frame, items, 0.8).collect()}
    assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
