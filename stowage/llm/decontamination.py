"""Benchmark passages in documents, by SimHash of item-sized windows.

For a benchmark item of n words every window of n words of a document is held
against it. A window without a shingle of the item has similarity zero, so only
windows around shared shingles are fingerprinted. Their SimHash is looked up
among the items of that length by a multi-index: 64 bits in eight blocks, and a
fingerprint within ``RADIUS`` bits is within ``RADIUS // 8`` bits in one block
at least, so none is missed. What is within the radius is verified by weighted
Jaccard similarity of the word shingles (weight: occurrences).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import runs
from stowage.llm.tables import documents

SHINGLE = 5  # words
SIMILARITY = 0.8
RADIUS = 24  # bits: windows of that similarity differ in about 10, and in more than 24 once in a million
BLOCKS = 8
BENCHMARK_BYTES = 16 << 20  # benchmark text that is sent to the tasks at once
_SCHEMA = "doc_id long, item_id long, similarity double, start long, n_words int, distance int"

_GAPS = np.zeros(256, bool)
_GAPS[:128] = [not chr(b).isalnum() for b in range(128)]
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.lower().encode() if t else b"" for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of lower-cased texts, and where each text's begin.

    A word is a run of ASCII letters, ASCII digits and characters beyond ASCII.
    """
    data, offsets = _lowered(texts)
    starts, ends = runs.words(data, offsets, _GAPS)
    return runs.word_codes(data, starts, ends), np.searchsorted(starts, offsets)


def _shingles(codes: np.ndarray, k: int) -> np.ndarray:
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    n = len(codes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + codes[i:n + i]
    return runs.mix(out)


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash_windows(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of ``shingles[s:s + size]``; ``starts`` ascend."""
    out = np.empty(len(starts), np.uint64)
    # Stretches of overlapping windows, a bounded number of shingles at a time.
    breaks = np.flatnonzero(np.diff(starts) > size) + 1
    for a, z in zip([0, *breaks], [*breaks, len(starts)]):
        for at in range(a, z, 1 << 14):
            part = starts[at:min(z, at + (1 << 14))]
            low, high = part[0], part[-1] + size
            sums = np.zeros((high - low + 1, 64), np.int32)
            np.cumsum(_bits(shingles[low:high]), axis=0, out=sums[1:])
            ones = sums[part - low + size] - sums[part - low]
            out[at:at + len(part)] = np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


class Items:
    """The benchmark items of one length, with their multi-index."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray], words: int, radius: int) -> None:
        self.ids, self.words, self.size, self.radius = ids, words, len(shingles[0]), radius
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.known = [np.unique(s) for s in shingles]
        self.prints = np.concatenate([simhash_windows(s, np.zeros(1, np.int64), len(s)) for s in shingles])
        values = np.arange(256, dtype=np.uint8)
        near = [np.bitwise_count(values[:, None] ^ block[None, :]) <= radius // BLOCKS
                for block in self.prints.view(np.uint8).reshape(-1, BLOCKS).T]
        self.index = [np.packbits(n, axis=1) for n in near]  # by block and value: items within reach

    def within(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (window, item) at most ``radius`` bits apart, and their distance."""
        for at in range(0, len(prints), 4096):
            part = prints[at:at + 4096]
            found = np.zeros((len(part), self.index[0].shape[1]), np.uint8)
            for block, values in enumerate(part.view(np.uint8).reshape(-1, BLOCKS).T):
                found |= self.index[block][values]
            window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.ids)))
            distance = np.bitwise_count(part[window] ^ self.prints[item])
            near = distance <= self.radius
            yield at + window[near], item[near], distance[near]


class Benchmark:
    """Items by length, and the lengths that each shingle occurs at."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int, radius: int) -> None:
        codes, offsets = _codes([text for _, text in rows])
        grouped = defaultdict(list)
        for (item, _), a, z in zip(rows, offsets, offsets[1:]):
            if z > a:
                grouped[int(z - a)].append((item, _shingles(codes[a:z], min(shingle, int(z - a)))))
        self.items = {n: Items([i for i, _ in part], [s for _, s in part], n, radius) for n, part in grouped.items()}
        self.shingle = shingle
        self.lengths = {k: sorted(n for n in self.items if min(shingle, n) == k) for k in range(1, shingle + 1)}
        pairs = [np.stack([np.concatenate(g.known), np.full(sum(map(len, g.known)), n, np.uint64)], 1)
                 for n, g in self.items.items()]
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
        self.seeds, self.seed_length = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)

    def seeded(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known shingles, and for each a length of items that have it."""
        low = np.searchsorted(self.seeds, shingles)
        hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == shingles) if len(self.seeds) else low[:0]
        many = np.searchsorted(self.seeds, shingles[hit], side="right") - low[hit]
        place = np.repeat(hit, many)
        entry = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return place, self.seed_length[entry]


def _matches(codes: np.ndarray, offsets: np.ndarray, known: Benchmark, similarity: float):
    """Best window of each (text, item) that is similar enough: text, item, similarity, start, words, distance."""
    for k, lengths in known.lengths.items():
        if not lengths:
            continue
        shingles = _shingles(codes, k)
        place, length = known.seeded(shingles)
        if not len(place):
            continue
        text = np.searchsorted(offsets, place, side="right") - 1
        # A seed that crosses into the next text is none.
        inside = place + k <= offsets[text + 1]
        place, length, text = place[inside], length[inside], text[inside]
        order = np.lexsort((place, length, text))
        place, length, text = place[order], length[order], text[order]
        cut = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (length[1:] != length[:-1]))))
        for a, z in zip(cut, [*cut[1:], len(place)]) if len(place) else ():
            i, n = int(text[a]), int(length[a])
            items = known.items.get(n)
            if items is None or min(known.shingle, n) != k or offsets[i + 1] - offsets[i] < n:
                continue
            low = np.maximum(place[a:z] - items.size + 1, offsets[i])
            high = np.minimum(place[a:z], offsets[i + 1] - n)
            opened = np.zeros(int(offsets[i + 1] - offsets[i]) + 1, np.int32)
            good = low <= high
            np.add.at(opened, low[good] - offsets[i], 1)
            np.add.at(opened, high[good] + 1 - offsets[i], -1)
            starts = np.flatnonzero(np.cumsum(opened) > 0) + offsets[i]
            yield from ((i, *m) for m in _verified(shingles, starts, items, offsets[i], similarity))


def _verified(shingles: np.ndarray, starts: np.ndarray, items: Items, base: int, similarity: float):
    size = items.size
    least = 2 * size * similarity / (1 + similarity) - 1e-9  # common shingles that the similarity needs
    best: dict[int, tuple] = {}
    prints = simhash_windows(shingles, starts, size) if len(starts) else np.zeros(0, np.uint64)
    for window, item, distance in items.within(prints):
        for j in np.unique(item):
            mine = window[item == j]
            far = distance[item == j]
            low, high = int(starts[mine[0]]), int(starts[mine[-1]]) + size
            common = np.zeros(high - low + 1, np.int32)
            np.cumsum(np.isin(shingles[low:high], items.known[j]), out=common[1:])
            at = starts[mine] - low
            for w in np.flatnonzero(common[at + size] - common[at] >= least):
                start = int(starts[mine[w]])
                have = Counter(shingles[start:start + size].tolist())
                both = (have & items.counts[j]).total()
                value = both / (2 * size - both)
                if value >= similarity and (j not in best or value > best[j][0]):
                    best[j] = (value, start - int(base), int(far[w]))
    for j, (value, start, far) in sorted(best.items()):
        yield items.ids[j], value, start, items.words, far


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of bounded size, one after another: one, unless it is very large."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    n = -(-total // BENCHMARK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield [(r.item_id, r.text) for r in rows.filter(part == i).collect()]


def _scan(texts: list[str | None], known: Benchmark, similarity: float):
    """Matches of a list of texts, about a megabyte at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= 1 << 20):
            size += len(texts[to] or "")
            to += 1
        codes, offsets = _codes(texts[at:to])
        for i, *match in _matches(codes, offsets, known, similarity):
            yield at + i, *match
        at = to


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
            radius: int = RADIUS) -> DataFrame:
    """One row for each document and benchmark item it holds: the best window.

    Columns ``doc_id, item_id, similarity, start`` (first word of the window),
    ``n_words, distance`` (bits); of equally similar windows the first. An item
    of fewer than ``shingle`` words has one shingle, its whole; items without
    words (null, empty) match nothing, nor do such documents. Repeated rows are
    rows like others, on both sides; null ids stay null. Other columns are
    ignored; empty tables give an empty result. The benchmark goes to the tasks
    in parts of at most ``BENCHMARK_BYTES``, each with a scan of its own.
    """
    texts = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], _SCHEMA)
    for rows in _parts(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            known = Benchmark(sent.value, shingle, radius)
            for batch in batches:
                found = list(zip(*_scan(batch.column("text").to_pylist(), known, similarity)))
                if found:
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(found[0])), *map(pa.array, found[1:], kinds)],
                        names=["doc_id", "item_id", "similarity", "start", "n_words", "distance"])

        out = out.unionByName(texts.mapInArrow(run, _SCHEMA))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                      shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; nothing is shuffled."""
    for rows in _parts(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            known = Benchmark(sent.value, shingle, radius)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, *_ in _scan(batch.column("text").to_pylist(), known, similarity)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
