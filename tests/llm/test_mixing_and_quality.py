"""Budgets, the co-trained classifier, licences, and the pipeline."""

import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import licenses, mixing, quality


def test_fit_is_exact_where_a_brute_force_search_is():
    rng = random.Random(6)
    for _ in range(60):
        length = np.array(rng.sample(range(1, 40), rng.randint(1, 4)))
        count = np.array([rng.randint(1, 4) for _ in length])
        budget = rng.randint(0, int((length * count).sum()))
        sums = {int(np.dot(length, c)) for c in product(*(range(n + 1) for n in count))}
        taken = mixing.fit(length, count, budget)
        assert (taken >= 0).all() and (taken <= count).all()
        assert abs(int((length * taken).sum()) - budget) <= min(abs(s - budget) for s in sums if s <= budget)


def test_large_budgets_are_met(make):
    rng = np.random.default_rng(5)
    length = np.unique(rng.integers(1, 30_000, 3000))
    count = rng.integers(1, 50, len(length))
    budget = int((length * count).sum() * 0.37)
    taken = mixing.fit(length, count, budget)
    assert (taken <= count).all() and int((length * taken).sum()) == budget


def test_mix(make, awkward, nothing):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(900)]
    rows += [(1000 + i, "same size here", "a") for i in range(500)] + [(5000, "", "e"), (5001, None, "a")]
    docs = make(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert {d: r.taken for d, r in got.items()} == again and len(got) == len(rows)
    size, taken, target = defaultdict(int), Counter(), {}
    for d, text, source in rows:
        n = len((text or "").split())
        assert got[d].size == n and got[d].taken <= 3 * n and (n == 0 or got[d].taken % n == 0)
        size[source] += n
        taken[source] += got[d].taken
        target[source] = got[d].target
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, want = set(), {}
    while True:
        free = [s for s in order if s not in full]
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        want = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    rows_out = mixing.mixed(docs)
    assert rows_out.columns == docs.columns
    assert Counter(r.doc_id for r in rows_out.collect()) == Counter(
        {d: r.taken // r.size if r.size else 1 for d, r in got.items()})
    assert mixing.mix(awkward).count() == awkward.count() and mixing.mixed(awkward).columns == awkward.columns
    assert mixing.mix(nothing).count() == mixing.mixed(nothing).count() == 0


def test_quality_on_held_out_documents(make, awkward, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        text = " ".join(words).capitalize() + "." if good else rng.choice(
            [" ".join(w.upper() + "!!" for w in words), " ".join(words[:2] * 40)])
        rows.append((i, text, "en", "s1", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
        rows[-1] += (int(good),)
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long, truth int")
    model = quality.train(docs, make(labels, "doc_id long, quality int, toxic int"), exchanged=40)
    wrong = quality.score(docs, model).join(docs, "doc_id").filter("doc_id % 2 = 0 and keep <> (truth = 1)").count()
    assert wrong <= 3
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).filter("keep").count()
    assert quality.score(awkward, model).count() == awkward.count()
    assert quality.keep_good(awkward, None).count() == awkward.count()
    assert quality.score(nothing, model).count() == 0
    assert quality.train(docs, make([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")) is None


def test_a_sample_of_the_labels_means_the_same_as_all(make):
    """Labels that nothing explains: every document has the chance of the class, however many labels are fitted on."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "four"], k=30)), "en", "s", 150) for i in range(2000)]
    labels = [(i, int(rng.random() < 0.8)) for i in range(2000)]
    docs = make(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = make(labels, "doc_id long, quality int")
    means = [quality.score(docs, quality.train(docs, marks, labelled=n)).agg(F.avg("score")).first()[0] for n in (10_000, 600)]
    assert all(abs(m - 0.8) < 0.05 for m in means), means


def test_licences(spark, make, awkward, nothing):
    known = licenses.known_licences(spark)
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 1999 Someone\n\n" + mit.upper().replace(",", ";")), (2, mit.replace("notice", "note", 1)),
            (3, "Some text\n  released UNDER the mit licence!\nmore"), (4, None), (5, "(c) 2001 A")]
    got = {r.doc_id: r for r in licenses.scan(make(rows, "doc_id long, text string"), known).collect()}
    assert got[1].licence == "MIT" and got[2].licence is None
    assert got[3].licence is None and got[3].line_licences == "MIT"
    assert got[4].digest is None and got[5].digest is None and got[4].line_licences == ""
    assert licenses.scan(awkward, known).count() == awkward.count()
    assert licenses.scan(nothing, known).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = out
    final = corpus_pipeline.run(spark, sf)
    assert final.filter(F.col("shard").between(0, 7)).count() == final.count() > 0


def test_drawn_rows_are_those_with_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from stowage.llm.tables import drawn

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    best = rows.orderBy(F.xxhash64(F.lit(7), "doc_id")).limit(300)
    assert {r.doc_id for r in drawn(rows, 300, 7, "doc_id").collect()} == {r.doc_id for r in best.collect()}
    assert drawn(rows, 30_000, 7, "doc_id").count() == 20_000
    assert drawn(rows.limit(0), 300, 7, "doc_id").count() == 0


def test_the_surest_rows_by_view_and_side(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), 9.0 if i % 3 else -9.0) for i, a in enumerate(rng.normal(0, 4, 5_000))]
    scored = spark.createDataFrame(rows, "doc_id long, by_text double, by_page double")
    found = quality._surest(scored, 3.0, 200)
    # Two hundred of each side; apart from the border step exactly the outermost.
    for sign in (1, -1):
        mine = [r.by_text * sign for r in found["by_text"] if r.y == (sign > 0)]
        best = sorted((a * sign for _, a, _ in rows if a * sign >= 3.0), reverse=True)[:200]
        assert len(mine) == 200 and np.allclose(sorted(mine, reverse=True), best, atol=2 / quality.GRAIN)
    # Thousands that are equally sure: still two hundred of each side, by a seeded draw.
    assert [sum(r.y == y for r in found["by_page"]) for y in (1.0, 0.0)] == [200, 200]
    assert quality._surest(scored.filter("abs(by_text) < 3 and by_page is null"), 3.0, 200) == {"by_text": [], "by_page": []}


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_that_share_an_id_are_not_taken_together(make, doc_id):
    rows = [(doc_id, "a b c d e f g h i", "s0")] * 1000 + [(i, "x y", "s1") for i in range(3000)]
    docs = make(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for source_size in (9000, 6000):
        mine = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 9
    assert sum(len(r.text.split()) for r in mixing.mixed(docs).collect()) == sum(r.taken for r in got)
