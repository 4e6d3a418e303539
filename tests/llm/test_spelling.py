"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

from stowage.llm import spelling


def expected(rows, length=6, occurrences=5, ratio=5, slip=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= occurrences}
    alphabet = sorted({c for w in counts for c in w})
    forms, out = {}, {}
    for w, n in counts.items():
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        near = [x for x in near if x != w and x in counts]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * n else None
        out[w] = (forms[w], n, len(near), counts[best] if forms[w] else None)

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def noisy(rng, base, documents):
    rows = []
    for d in range(documents):
        words = []
        for _ in range(rng.randint(0, 120)):
            word = base[min(int(rng.expovariate(0.35)), len(base) - 1)]
            roll, at = rng.random(), rng.randrange(len(word))
            if roll < 0.05:
                word = word[:at] + word[at + 1:]
            elif roll < 0.1:
                word = word[:at] + rng.choice("abé") + word[at + 1:]
            elif roll < 0.15:
                word = word[:at] + rng.choice("aab") + word[at:]
            words.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((d, ", ".join(words) + rng.choice(["", "1x", "×÷", "Őend"])))
    return rows


def test_variants_against_brute_force(make):
    rng = random.Random(11)
    base = ["aaaabbbb", "aaaabbb", "letters", "letteré", "étéétéé", "abababab", "babababa", "abcdef",
            "abcdefg", "abcdefgh", "zzzzzz", "straßeÉÉ"]
    rows = noisy(rng, base, 400)
    rows += [(None, "letters letterz " * 3), (7, None), (8, ""), (9, "letters"), (9, "letters")]
    for slip in (199, 3):
        got = spelling.variants(make(rows, "doc_id long, text string"), slip=slip).collect()
        want = expected(rows, slip=slip)
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(w[2] not in (w[0], w[1]) for w in want) and any(w[4] > 8 for w in want)


def test_long_words_meet_across_the_border_of_written_prefixes(make):
    limit = spelling.LITERAL
    rows = []
    for n, size in enumerate((limit - 1, limit, limit + 1, 5000, 5001)):
        rows += [(n, " ".join(["q" * (size - 1) + "w"] * (5 if n % 2 else 30)))]
    got = spelling.variants(make(rows, "doc_id long, text string"), slip=1 << 40).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected(rows, slip=1 << 40)
    assert {r.n_near for r in got} == {1, 2}


def test_equally_frequent_long_words_keep_their_order(make):
    head = "q" * (spelling.LITERAL + 30)
    text = " ".join([head + "c"] * 5 + [head + "b"] * 30 + [head + "a"] * 30 + [head] * 30)
    got = {r.word[len(head):]: r.form for r in spelling.variants(make([(1, text)], "doc_id long, text string"), slip=1 << 40).collect()}
    assert got == {"c": head, "b": None, "a": None, "": None}
    got = spelling.variants(make([(1, text.replace(head + " ", "") + "x")], "doc_id long, text string"), slip=1 << 40).collect()
    assert {r.word[len(head):]: r.form for r in got}["c"] == head + "a"


def test_texts_are_cut_between_runs(make, monkeypatch):
    rows = noisy(random.Random(3), ["pieces", "abcdéfgh"], 10)
    for _, text in rows:
        low = text.lower().encode()
        parts = list(spelling.pieces(low, 16))
        assert b"".join(parts) == low
        assert [w for p in parts for w in spelling._RUN.findall(p)] == spelling._RUN.findall(low)


def test_awkward_rows(awkward, nothing):
    got = {r.word: (r.n, r.n_near, r.form) for r in spelling.variants(awkward, length=3, occurrences=2, slip=1 << 40).collect()}
    assert got["brown"] == (2, 0, None) and got["word"][0] == 80
    assert spelling.variants(nothing).collect() == []
