"""Periodic runs against brute force."""

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import pytest

from stowage.llm import periodic


def brute(words, shortest=6, power=4):
    found = []
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        at = 0
        for i, x in enumerate(same):
            if not x:
                if i > at and i - at + q >= max(shortest, power * q):
                    run = words[at:i + q]
                    if not any(all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                        found.append((at, i - at + q, q))
                at = i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(13)
    for n in range(400):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            block = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(words))
            words[at:at] = (block * rng.randint(1, 9))[:rng.randint(1, 70)]
        yield words
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield list(fibonacci[-1])
    yield list("aab" * 40 + "aabaab" * 3 + "ab" * 30)
    yield ["a"] * 200


@pytest.mark.parametrize("shortest, power", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_sequences(shortest, power):
    total = 0
    for words in sequences():
        want = brute(words, shortest, power)
        assert periodic.maximal_runs(words, shortest, power) == want
        assert periodic.text_runs(words, shortest, power) == want
        total += len(want)
    assert total > 100


def test_squares_are_squares_and_hold_every_primitive_one():
    for words in list(sequences())[::7]:
        got = set(periodic.squares(words))
        for end, period in got:
            low = end + 1 - 2 * period
            assert low >= 0 and words[low:low + period] == words[low + period:end + 1]
        for start, length, period in brute(words, 2, 2):
            assert {(e, period) for e in range(start + 2 * period - 1, start + length)} <= got


def test_an_access_returns_each_piece_of_another_colour():
    """The tree's paths against a plain walk to the root."""
    rng = random.Random(5)
    link, _, ends = periodic.automaton([rng.choice("ab") for _ in range(300)])
    paths, colour = periodic.Paths(link), [-1] * len(link)
    for i, node in enumerate(ends):
        want, at = [], node
        while at:
            if colour[at] >= 0 and (not want or want[-1][0] != colour[at]):
                want.append((colour[at], at))
            colour[at] = i
            at = link[at]
        assert paths.access(node, i) == want


def digests(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def found(docs):
    rows = periodic.run_digests(periodic.periodic_runs(docs, rewrite=periodic.echoed)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_documents(make):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["cé", "漢", "b", "a"][:2 + i % 3]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(500 + i, "\t".join(f"w{rng.randint(0, 40)}" for _ in range(120))) for i in range(100)]
    rows += [(7, "x\x0by " * 30), (7, "x\x0by " * 30), (7, "z z"), (None, "la " * 9), (None, None)]
    got = found(make(rows, "doc_id long, text string"))
    assert got == sorted((digests(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert found(awkward) == sorted((digests(*r) if len(r[1] or "") < 100_000 else (
        4, 0, None, None, None, None, sha256(b"").hexdigest(), sha256(r[1].encode()).hexdigest()) for r in rows), key=str)
    assert found(nothing) == []


def test_long_texts_are_split_alike():
    text = ("one two\tthree\x0b" * 200_000).encode()
    assert len(text) > 2 * periodic.PIECE and periodic.split(text) == text.split()
