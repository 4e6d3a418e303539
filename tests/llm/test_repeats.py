"""Repeated words and bytes against a comparison of all windows."""

import hashlib
import random

import numpy as np
import pytest

from stowage.llm import firsts, runs, substring_dedup, suffix_dedup


def brute(rows, width, cut, join):
    seen, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        units = cut((text or "").encode())
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            place = seen.setdefault(tuple(units[i:i + width]), (doc, i))
            if place != (doc, i):
                gone[i:i + width] = [True] * width
        kept = join([u for u, g in zip(units, gone) if not g])
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[doc] = (len(units), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the", "of"] * 5
    phrases = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for doc in range(n):
        parts = [p for _ in range(rng.randint(0, 5)) for p in (rng.choice(phrases), rng.choices(words, k=rng.randint(0, 9)))]
        text = [w for p in parts for w in p]
        if text and rng.random() < 0.5:
            text[rng.randrange(len(text))] = f"edit{doc}"
        rows.append((doc * 3, rng.choice([" ", "\n", "  "]).join(text)))
    return rows + [(1000 + i, rows[5][1]) for i in range(30)] + [(7000, "ab" * 300), (7001, "ß" * 200), (7002, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, make, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           substring_dedup.remove_repeats(make(rows, "doc_id long, text string"), 12, 4).collect()}
    want = brute(rows, 12, bytes.split, b" ".join)
    assert got == {d: (n, g, h) for d, (n, g, _, h) in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, make, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           suffix_dedup.remove_repeats(make(rows, "doc_id long, text string"), 60, 16).collect()}
    assert got == brute(rows, 60, lambda b: [b[i:i + 1] for i in range(len(b))], b"".join)


def test_hot_anchors_give_the_same_rows(spark, make, monkeypatch):
    rows = corpus(3)
    docs = make(rows, "doc_id long, text string")
    every = np.arange(0)

    def all_hot(texts, by_word, k, width):
        found = [c[0] for c in firsts._block_batches(
            iter(texts.toArrow().to_batches()), by_word, k, width)]
        return np.unique(np.concatenate(found)) if found else every

    monkeypatch.setattr(firsts, "hot_anchors", all_hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           suffix_dedup.remove_repeats(docs, 60, 16).collect()}
    assert got == brute(rows, 60, lambda b: [b[i:i + 1] for i in range(len(b))], b"".join)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 12, 4).collect()}
    assert got == {d: (n, g) for d, (n, g, _, _) in brute(rows, 12, bytes.split, b" ".join).items()}


def maximal_repeats(texts, width):
    """All strings of ``width`` and more that occur twice and that no byte to either side extends everywhere."""
    places = {}
    for t, text in enumerate(texts):
        for a in range(len(text)):
            for z in range(a + width, len(text) + 1):
                places.setdefault(text[a:z], []).append((t, a))
    out = {}
    for word, at in places.items():
        left = {texts[t][a - 1] if a else (t, a) for t, a in at}
        right = {texts[t][a + len(word)] if a + len(word) < len(texts[t]) else (t, a) for t, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out[word] = sorted(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeat_groups_are_the_maximal_repeats_with_all_occurrences(seed):
    rng = random.Random(seed)
    shared = [bytes(rng.choices(b"ab", k=rng.randint(4, 30))) for _ in range(4)]
    texts = [b"".join(rng.choice([rng.choice(shared), bytes(rng.choices(b"abc", k=5))]) for _ in range(rng.randint(1, 6)))
             for _ in range(9)] + [b"a" * 20, b"", b"abc", shared[0], shared[0]]
    width = 4
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    piece, inside, common = suffix_dedup.suffix_array(data, begins, lengths, np.maximum(lengths - width + 1, 0))
    suffixes = [texts[p][i:] for p, i in zip(piece, inside)]
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == same
    before = np.where(inside > 0, data[np.maximum(begins[piece] + inside - 1, 0)].astype(np.int64), -1)
    place = np.empty(len(piece), np.int64)
    place[np.lexsort((inside, piece))] = np.arange(len(piece))
    groups, repeats = suffix_dedup.repeat_groups(common, before, place, width)
    got = {texts[piece[low]][inside[low]:inside[low] + n]:
           sorted((int(piece[i]), int(inside[i])) for i in range(low, high + 1)) for low, high, n in groups}
    assert got == maximal_repeats(texts, width)
    assert len({s for s, _ in repeats}) == len(repeats)


@pytest.mark.parametrize("seed", range(4))
def test_factors_are_the_longest_and_the_parse_is_greedy(seed):
    width, gram = 6, 2
    rng = random.Random(seed)
    phrases = [rng.choices(range(12), k=rng.randint(4, 25)) for _ in range(6)]
    texts = [[w for _ in range(4) for w in [*rng.choice(phrases), rng.randrange(12)]] for _ in range(12)]
    codes = np.random.default_rng(5).integers(0, 1 << 63, 12, dtype=np.uint64)
    blocks = []
    for doc, text in enumerate(texts):
        symbols = codes[text]
        for anchor, _, first, n in zip(*runs.blocks(symbols, np.full(len(symbols), len(symbols)), gram, width)):
            blocks.append((int(anchor), doc, int(first), [int(c) for c in symbols[first:first + n + width - 1]]))
    blocks.sort(key=lambda b: b[:3])
    lengths = np.array([len(b[3]) for b in blocks])
    longest = substring_dedup.longest_factors(
        np.array([c for b in blocks for c in b[3]], np.uint64), np.cumsum(lengths) - lengths, lengths,
        np.array([b[0] for b in blocks], np.uint64), np.arange(len(blocks)), width, gram)

    def best(k, at):
        """By comparison with every start in every earlier block of the anchor."""
        found = 0
        for other in (b for b in blocks[:k] if b[0] == blocks[k][0]):
            for start in range(len(other[3])):
                same = 0
                for x, y in zip(blocks[k][3][at:], other[3][start:]):
                    if x != y:
                        break
                    same += 1
                found = max(found, same)
        return found if found >= width else 0

    want = [[best(k, at) for at in range(n)] for k, n in enumerate(lengths - width + 1)]
    assert [row[:len(w)].tolist() for row, w in zip(longest, want)] == want and any(map(any, want))
    factors, boundary = substring_dedup.greedy_parse(longest, lengths - width + 1, width)
    parsed, cut = [], []
    for k, row in enumerate(want):
        at = 0
        while at < len(row):
            if row[at]:
                parsed.append((k, at, row[at]))
                end = at + row[at]
                cut += [(k, i, row[i]) for i in range(max(at, end - width) + 1, min(end, len(row))) if row[i]]
            at += max(row[at], 1)
    assert sorted(zip(*(c.tolist() for c in factors))) == parsed
    assert sorted(zip(*(c.tolist() for c in boundary))) == cut


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_rows_that_repeat_an_id_do_not_remove_each_other(make, module):
    text = " ".join(f"word{i}" for i in range(80))
    got = module.remove_repeats(make([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed == 0) for r in got) == [(1, True), (1, True), (2, False)]


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_awkward_rows(awkward, nothing, module):
    got = module.remove_repeats(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_removed == 0 and by[8][1] == 0 and by[7][1] == 0
    assert by[2].n_removed == by[2][1] > 0
    assert module.remove_repeats(nothing).count() == 0


def test_words_that_letter_sums_confuse_are_told_apart(make):
    """A Thue-Morse word and the one with its letters swapped have equal linear hashes of any odd base."""
    swapped = ["".join("ab"[(n.bit_count() + k) % 2] for n in range(1024)) for k in (0, 1)]
    common = [f"w{i}" for i in range(19)]
    rows = [(k, " ".join([*common, w])) for k, w in enumerate(swapped)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(make(rows, "doc_id long, text string"), 20).collect()}
    assert got == {0: 0, 1: 0}
