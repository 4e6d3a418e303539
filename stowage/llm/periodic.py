"""Periodic runs of words, found by a suffix automaton whose link tree is accessed like a link-cut tree.

Each state of the automaton stands for the suffixes of some prefixes; its
suffix links form a tree. When word ``i`` is appended, the path from its prefix
to the root holds every suffix that ends at ``i``. The tree keeps paths of one
colour: the last word at which a suffix on them ended. Appending recolours the
whole path (an access of a link-cut tree: a few pieces of other colours each
time, in the mean a logarithm). A piece last seen at ``e`` whose longest suffix
has at least ``i - e`` words is a square of period ``i - e`` that ends at ``i``.
Every square of a primitive word shows up like that, because its root occurred
last exactly one period before. Squares are widened to maximal runs, each once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import runs as texts
from stowage.llm.tables import documents

SHORTEST = 6  # words of a run, at least
POWER = 4  # periods of a run, at least
ROUNDS = 8  # passes that cut a text where no run can be
PIECE = 1 << 20  # bytes of a text that are split at once
RUNS = "array<struct<start:long,length:long,period:long>>"
SCHEMA = f"doc_id long, n_words long, runs {RUNS}, strongest struct<start:long,length:long,period:long>, collapsed string"

_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton(symbols: Sequence) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state, and the state of each prefix; state 1 is the start, 0 none."""
    step: list[dict] = [{}, {}]
    link, size, ends = [0, 0], [0, 0], []
    last = 1
    for symbol in symbols:
        state = len(size)
        size.append(size[last] + 1)
        step.append({})
        link.append(1)
        at = last
        while at and symbol not in step[at]:
            step[at][symbol] = state
            at = link[at]
        if at:
            target = step[at][symbol]
            if size[target] == size[at] + 1:
                link[state] = target
            else:
                twin = len(size)
                size.append(size[at] + 1)
                step.append(step[target].copy())
                link.append(link[target])
                while at and step[at].get(symbol) == target:
                    step[at][symbol] = twin
                    at = link[at]
                link[target] = link[state] = twin
        last = state
        ends.append(state)
    return link, size, ends


class Paths:
    """The link tree as a set of paths, each a splay tree ordered by depth, with one colour."""

    def __init__(self, link: list[int]) -> None:
        self.up = link.copy()  # parent in the splay tree, or the tree's parent of the whole path
        self.left = [0] * len(link)
        self.right = [0] * len(link)
        self.colour = [-1] * len(link)  # of a path, kept at the root of its splay tree

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from ``node`` to the root one colour; the old colours, each with its deepest node on it."""
        up, right, colours = self.up, self.right, self.colour
        old, below = [], 0
        while node:
            self._splay(node)
            seen = colours[node]
            if seen >= 0:
                old.append((seen, node))
            deeper = right[node]
            if deeper:
                colours[deeper] = seen
            right[node] = below
            below, node = node, up[node]
        colours[below] = colour
        return old


def squares(symbols: Sequence) -> Iterator[tuple[int, int]]:
    """``(end, period)`` of squares, among them every one of a primitive word; ``end`` is its last place."""
    link, size, ends = automaton(symbols)
    paths = Paths(link)
    for i, state in enumerate(ends):
        for seen, deepest in paths.access(state, i):
            if i - seen <= size[deepest]:
                yield i, i - seen


def _factors(n: int) -> Iterator[int]:
    prime = 2
    while prime * prime <= n:
        if n % prime == 0:
            yield prime
            while n % prime == 0:
                n //= prime
        prime += 1
    if n > 1:
        yield n


def _period(symbols: Sequence, start: int, end: int, period: int) -> bool:
    return symbols[start:end - period] == symbols[start + period:end]


def maximal_runs(symbols: Sequence, shortest: int = SHORTEST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of runs of at least ``shortest`` symbols and ``power`` (2 or more) periods."""
    found, reach = [], {}
    for end, period in squares(symbols):
        if reach.get(period, -1) >= end:
            continue
        low, high = end - 2 * period + 1, end + 1
        while low and symbols[low - 1] == symbols[low - 1 + period]:
            low -= 1
        while high < len(symbols) and symbols[high] == symbols[high - period]:
            high += 1
        reach[period] = high - 1
        # Of a stretch of two periods, a smaller one divides the period.
        if high - low >= max(shortest, power * period) and not any(
                _period(symbols, low, high, period // f) for f in _factors(period)):
            found.append((low, high - low, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: Sequence, shortest: int = SHORTEST, power: int = POWER) -> Iterator[tuple[int, int]]:
    """Stretches that hold every run: a run has each of its words ``power`` times.

    A text is cut at words that are rarer, its parts again. Passes are limited
    only to bound the time; what is left uncut is searched all the same.
    """
    long = re.compile(b"\x01{%d,}" % shortest)
    parts = [(0, len(words))] if len(words) >= shortest else []
    for _ in range(ROUNDS):
        cut = []
        for a, z in parts:
            part = words[a:z]
            common = {w for w, n in Counter(part).items() if n >= power}
            cut += [(a + m.start(), a + m.end()) for m in long.finditer(bytes([w in common for w in part]))]
        if cut == parts:
            break
        parts = cut
    yield from parts


def text_runs(words: Sequence, shortest: int = SHORTEST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a whole text, by start and period."""
    found = []
    for a, z in stretches(words, shortest, power):
        found += [(a + start, length, period) for start, length, period in maximal_runs(words[a:z], shortest, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def split(text: bytes) -> list[bytes]:
    """Words between ASCII white space; those of a long text share their equals."""
    if len(text) <= PIECE:
        return text.split()
    gap, known, out, at = re.compile(rb"[\x20\x09-\x0D]"), {}, [], 0
    while at < len(text):
        cut = gap.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        out += [known.setdefault(w, w) for w in text[at:end].split()]
        at = end
    return out


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, power: int = POWER,
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, strongest, collapsed``.

    ``runs`` are maximal stretches of words that repeat with a smallest period,
    of at least ``shortest`` words and ``power`` (2 or more) periods, by start
    and period; words count from 0. ``strongest`` has the greatest
    length / period (ties: smallest start, then period), null without runs.
    ``collapsed`` is the text of the words that no run holds behind its first
    period, joined by one blank. ``rewrite`` may change a document's words
    before they are searched. Null and empty texts have no words and collapse
    to an empty text; ids may be null or repeat, each row is judged alone;
    other columns are ignored; an empty table gives an empty result. A task
    holds the words of one text at a time, in its automaton only the stretches
    in which all words are frequent.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")

    def run(batches):
        for batch in batches:
            data, offsets = texts.texts(batch)
            ids = batch.column("doc_id").to_pylist()
            for low, high in texts.packs(offsets):
                out = []
                for n in range(low, high):
                    words = split(data[offsets[n]:offsets[n + 1]].tobytes())
                    if rewrite:
                        words = rewrite(ids[n], words)
                    found = text_runs(words, shortest, power)
                    kept = bytearray(b"\x01") * len(words)
                    for start, length, period in found:
                        kept[start + period:start + length] = bytes(length - period)
                    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                    if found:
                        words = [w for w, keep in zip(words, kept) if keep]
                    out.append((len(kept), [_named(r) for r in found], best and _named(best), b" ".join(words).decode()))
                numbers, found, best, collapsed = zip(*out)
                yield pa.record_batch([
                    pa.array(ids[low:high], pa.int64()), pa.array(numbers, pa.int64()),
                    pa.array(found, pa.list_(_RUN_TYPE)), pa.array(best, _RUN_TYPE), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def _named(run: tuple[int, int, int]) -> dict[str, int]:
    return dict(zip(("start", "length", "period"), run))


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by its id's checksum, the words from some place on repeat those before; a null id none."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """Number, strongest one and digest of the runs of each document, and the digest of its collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(documents(spark, sf_dir), rewrite=echoed))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}
