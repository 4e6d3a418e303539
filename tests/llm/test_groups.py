"""SimHash groups, benchmark matches, neighbours and shards against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from stowage.llm import decontamination, graph, multi_index, sharding, simhash_dedup


def test_golay_keys_find_every_pair_within_three_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    near = base.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            near[i] ^= np.uint64(1 << int(bit))
    keys = []
    for prints, first in ((base, True), (near, False)):
        row, key = simhash_dedup.search_keys(prints.view(np.int64), first)
        keys.append({(int(r), int(k)) for r, k in zip(row, key)})
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(base)))
    assert sorted(set(simhash_dedup.golay()[3])) == [1, 6]


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(rows):
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None)
           for r in set(root)}
    return sorted((d, f"{p:016x}", low[r]) for (d, _), p, r in zip(rows, prints, root))


def test_near_duplicates(make):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 20)) for _ in range(150)]
        rows.append((n, " ".join(words)))
        for c in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = "edit"
            rows.append((100 * n + 100 + c, " ".join(words).upper() if c else " ".join(words)))
    rows += [(9000, ""), (9001, None), (9002, "one"), (9003, "ONE"), (9004, "two words")]
    got = simhash_dedup.near_duplicates(make(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == linked(rows)
    assert len({r.component_id for r in got}) < len(rows)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = simhash_dedup.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = simhash_dedup.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    clash = awkward.withColumnsRenamed({"spans": "_kept", "shard": "kept_id"})
    assert simhash_dedup.keep_one_of_each(clash).columns == clash.columns
    assert simhash_dedup.near_duplicates(nothing).count() == simhash_dedup.keep_one_of_each(nothing).count() == 0


def test_components_of_a_chain_and_a_star(make):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, n) for n in range(101, 140)]
    got = {r.node: r.root for r in graph.components(make(chain, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(1, 41)} | {n: 100 for n in range(101, 140)}


def test_decontamination(spark, make, awkward, nothing):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 30, 31, 60])))) for i in range(20)]
    items += [(90, None), (91, ""), (92, items[0][1])]
    docs = []
    for n in range(80):
        parts = [word() for _ in range(rng.randint(0, 80))]
        if n % 2:
            item = rng.choice(items[:20])[1].split()
            for _ in range(n % 4 == 3):
                item[rng.randrange(len(item))] = word()
            parts[len(parts) // 2:len(parts) // 2] = item
        docs.append((n, ", ".join(parts).upper() if n % 3 else " ".join(parts)))

    def shingles(words, k):
        return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]

    want = {}
    for d, text in docs:
        words = re.findall("[a-z0-9]+", text.lower())
        for i, passage in items:
            item = re.findall("[a-z0-9]+", (passage or "").lower())
            k = min(5, len(item))
            for p in range(len(words) - len(item) + 1 if item else 0):
                a, b = Counter(shingles(words[p:p + len(item)], k)), Counter(shingles(item, k))
                value = (a & b).total() / (a | b).total()
                if value >= 0.8 and value > want.get((d, i), (0, 0))[0]:
                    want[d, i] = value, p
    table, known = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.matches(table, known).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in decontamination.without_benchmark(table, known).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.without_benchmark(awkward, known).count() == awkward.count()
    assert decontamination.matches(awkward, known.limit(0)).count() == 0
    assert decontamination.matches(nothing, known).count() == 0


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    shingles = [rng.integers(0, 1 << 62, 40, dtype=np.uint64) for _ in range(50)]
    items = decontamination.Items(list(range(50)), shingles, 44, 24)
    prints = items.prints.copy()
    for i in range(50):
        for bit in rng.choice(64, 24, replace=False):
            prints[i] ^= np.uint64(1 << int(bit))
    found = {(int(w), int(i)) for ws, its, _ in items.within(prints) for w, i in zip(ws, its)}
    assert {(i, i) for i in range(50)} <= found


def test_neighbours(make):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(2000, 16)).astype(np.float32)
    points[500:900] = points[500]  # one very common vector
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(3000, None, "x"), (3100, [0.0] * 16, "x"), (3200, [float("nan")] * 16, "x"), (3300, [1.0], "x"),
             (3400, [None] * 16, "x"), (None, points[1].tolist(), "x"), (7, points[7].tolist(), "x")]
    got = {}
    for r in multi_index.search(make(rows, "vec_id long, embedding array<float>, cell string"), sample=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 2000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(axis=1))
        order = [int(i) for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert np.allclose([s for _, _, s in sorted(found)], [d[v] for _, v, _ in sorted(found)], rtol=1e-12, atol=0)
        hits += len({v for _, v, _ in found} & set(order))
        if 500 <= q < 900:
            assert [v for _, v, _ in sorted(found)] == order
    assert hits / (10 * len(got)) >= 0.9
    few = multi_index.search(make(rows[:4], "vec_id long, embedding array<float>, cell string"))
    assert few.count() == 3
    assert multi_index.search(make([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [2_000, 12_000])
def test_recall_against_brute_force(make, n):
    points = np.random.default_rng(5).normal(size=(n, 32))
    table = make([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in multi_index.search(table).collect()}
    hits = 0
    for q in range(0, n, 100):
        d = ((points - points[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += sum((q, int(i)) in found for i in np.argsort(d, kind="stable")[:10])
    assert len(found) == n // 100 * 10 and hits >= 0.9 * len(found)


def test_rows_that_share_an_id_are_candidates_and_queries_each(make):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [5.2, 1.0])] * 3 + [(100, [20.4, 1.0])]
    got = {}
    for r in multi_index.search(make(rows, "vec_id long, embedding array<double>"), neighbours=4).collect():
        got.setdefault(r["rank"], []).append((r.query_id, r.vec_id, round(r.score, 6)))
    assert sorted(got[1]) == [(100, 20, 0.4), (100, 100, 0.0)]  # the lone row's and that of the three equal ones
    assert sorted(got[3]) == [(100, 5, 0.2), (100, 19, 1.4)]
    assert sorted(got) == [1, 2, 3, 4] and all(len(v) == 2 for v in got.values())


def test_shards(make, awkward, nothing):
    keys = np.arange(20_000)
    for n in range(1, 12):
        now, more = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert now.max() == n - 1 and set(more[more != now]) <= {n}
    assert np.bincount(sharding.jump(keys, 8)).min() > 2300
    rows = sharding.assign(awkward).collect()
    assert len(rows) == awkward.count() and sharding.assign(nothing).count() == 0
    slots = {}
    for r in rows:
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter(len((r.text or "").encode()) + 1 for r in awkward.collect())
    assert Counter(r.size for r in rows) == texts
    assert {r.text_crc32 for r in rows} == {zlib.crc32((r.text or "").encode()) for r in awkward.collect()}


def test_more_parts_than_entries_change_nothing(make):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(400, 8)).tolist())]
    docs = make(rows, "vec_id long, embedding array<double>")
    one, many = ({tuple(r) for r in multi_index.search(docs, every=20, block=b).collect()} for b in (1 << 14, 3))
    assert one == many and len(one) == 200


def test_neighbours_do_not_depend_on_the_groups_of_centroids(make, monkeypatch):
    rng = np.random.default_rng(3)
    docs = make(list(enumerate(rng.normal(size=(900, 8)).tolist())), "vec_id long, embedding array<double>")
    got = []
    for groups in (1, 5, 1000):
        monkeypatch.setattr(multi_index, "GROUPS", groups)
        got.append({(r.query_id, r["rank"], r.vec_id) for r in multi_index.search(docs, every=30).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 300
