"""Links between shingle sets against brute force."""

import random
import re

import numpy as np
import pytest

from stowage.llm import signature_join as S


def sets_of(rows, shingle):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    return out


def brute(rows, shingle=4, similar=(85, 100)):
    sets, root = sets_of(rows, shingle), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and similar[1] * both >= similar[0] * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None)
           for r in set(root)}
    return sorted(((d, len(s), low[r]) for (d, _), s, r in zip(rows, sets, root)), key=str)


def joined(docs, **more):
    return sorted((tuple(r) for r in S.similar_sets(docs, **more).collect()), key=str)


def corpus(seed, families, edits):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    common = [word() for _ in range(60)]
    rows = []
    for n in range(families):
        base = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 40, 150, 400]))]
        if n % 3 == 0:
            base[len(base) // 2:len(base) // 2] = common
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randint(0, len(copy))
                copy[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile, fan", [(512, 8), (8, 2)])
def test_components_against_brute_force(make, monkeypatch, tile, fan):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(S, "FAN", fan)
    rows = corpus(1, 120, 9) + [(5000, "Same Words"), (5001, "same words"), (5002, ""), (5003, None), (None, "same words"),
                                (None, "alone among nulls"), (5004, " \t"), (5002, "same words and more"), (5000, "Same Words")]
    want = brute(rows)
    assert joined(make(rows, "doc_id long, text string")) == want
    assert len({c for _, _, c in want}) < len(rows) - 40


def test_trees_find_what_the_early_pairs_miss(make, monkeypatch):
    monkeypatch.setattr(S, "AGREE", 5)  # more than there are: no pair is compared early
    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "LARGE", 60)  # larger sets need several shared shingles
    rows = corpus(2, 60, 9)
    assert joined(make(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("shingle, similar", [(2, (60, 100)), (1, (1, 2)), (5, (1, 1))])
def test_other_thresholds(make, shingle, similar):
    rows = corpus(3, 40, 25)
    assert joined(make(rows, "doc_id long, text string"), shingle=shingle, similar=similar) == brute(rows, shingle, similar)


def test_trees_leave_no_possible_pair(monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    monkeypatch.setattr(S, "SLICE", 50)
    rng = np.random.default_rng(4)
    universe = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = []
    for n in range(200):
        if n % 4:
            old = sets[rng.integers(0, len(sets))]
            sets.append(np.unique(np.concatenate((old[rng.random(len(old)) > 0.05], rng.choice(universe, 3)))))
        else:
            sets.append(np.unique(rng.choice(universe, rng.integers(1, 300))))
    bits = np.frombuffer(b"".join(map(S.bitmap, sets)), np.uint64).reshape(-1, S.WIDTH // 64)
    size = np.array([len(s) for s in sets])
    mark = rng.integers(0, 60, 200)
    group = np.repeat([0, 1, 4], [90, 60, 50])  # sides 0 and 1 of one cell, and a cell alone
    trees = S.Trees(group, bits, size, mark)
    got = {(int(x), int(y)) for a, b in trees.meet(np.array([0, 2]), np.array([1, 2]), S.SIMILAR) for x, y in zip(a, b)}
    linked, total = 0, 0
    for i in range(200):
        for j in range(200):
            if (group[i], group[j]) in ((0, 1), (4, 4)) and (group[i] != group[j] or i < j):
                total += 1
                same = mark[i] == mark[j]
                linked += not same and S._similar(sets[i], sets[j], S.SIMILAR)
                assert (i, j) in got or same or not S._similar(sets[i], sets[j], S.SIMILAR)
                assert not (same and (i, j) in got)
    assert 30 < linked <= len(got) < total / 4


def test_first_shingles_hold_what_similar_sets_share():
    rng = random.Random(6)
    for n in (1, 2, 7, 300, 1024, 1025, 4000):
        for _ in range(30):
            a = set(range(n))
            b = (a - set(rng.sample(range(n), int(n * rng.random() * 0.15)))) | {n + i for i in range(int(n * rng.random() * 0.1))}
            if S._similar(np.array(sorted(a)), np.array(sorted(b)), S.SIMILAR):
                order = {t: rng.random() for t in a | b}
                first = [set(sorted(s, key=order.get)[:S.first_shingles(len(s))]) for s in (a, b)]
                assert len(first[0] & first[1]) >= min(S.shared_at_least(len(a)), S.shared_at_least(len(b)))


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert joined(awkward) == brute(rows)
    assert joined(nothing) == []
