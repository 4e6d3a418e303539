"""Removal of repeated word sequences by relative Lempel-Ziv factoring.

The reference is the corpus itself, cut into content-defined blocks and indexed
by anchor (see ``firsts``). A block whose words all stand in an earlier block
is one factor as a whole. Every other block that shares its anchor with one
brings its words to the task of the anchor and is parsed there, from left to
right: the longest factor that starts at a word, against all earlier blocks of
the index, is taken if it has ``width`` words or more, and the parse goes on
behind it; else the word is a literal. Windows that a factor's end cuts are
looked up by themselves, so the result equals a comparison of all windows.

Equal windows pick the same anchor, so a factor of ``width`` words stands at
the same distance from the anchor in both blocks, and blocks need only be
compared side by side. Anchors that are too common for one task are not
factored: their windows are dealt by hash and looked up one by one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import firsts, runs
from stowage.llm.tables import documents, partitions

WIDTH = 20  # words of a window
GRAM = 8  # words of an anchor
BUCKETS = 4  # packing buckets per shuffle partition; there are few blocks to check
PIECE = 1 << 16  # blocks that are factored at a time, if anchors allow
_SECOND = np.uint64(0xD1B54A32D192ED03)
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"


def _classes(label: np.ndarray, key: np.ndarray, place: np.ndarray):
    """Split classes by ``key``: the new label and size of each row's class, and whether another comes before it."""
    order = np.lexsort((place, key, label))
    new = np.ones(len(order), bool)
    new[1:] = (label[order][1:] != label[order][:-1]) | (key[order][1:] != key[order][:-1])
    number = np.cumsum(new) - 1
    out, again = np.empty(len(order), np.int64), np.empty(len(order), bool)
    out[order] = number
    again[order] = place[order] > place[order][new][number]
    return out, np.bincount(number)[out], again


def longest_factors(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, anchor: np.ndarray,
                    place: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The longest factor from each window start of each block, 0 where none has ``width`` words.

    Block ``i`` is ``codes[begins[i]:begins[i] + lengths[i]]``; a factor is a
    run of words that also stands in a block of the same anchor with a smaller
    ``place``. Words are compared themselves, by their codes.
    """
    windows, reach = lengths - width + 1, width - gram + 1
    longest = np.zeros((len(begins), int(windows.max(initial=0))), np.int32)
    if not len(begins):
        return longest
    grams = runs.gram_hash(codes, gram)
    # Where the anchor stands: the smallest gram of the first window, by the rule of ``runs.blocks``.
    anchored = (grams[begins[:, None] + np.arange(reach)] & ~runs.POSITIONS).argmin(axis=1)
    for back in range(reach):
        first = anchored - back
        member = np.flatnonzero((first >= 0) & (first < windows))
        low = begins[member] + first[member]
        label, size, again = _classes(anchor[member], _window_hashes(codes, low, width)[0], place[member])
        head = np.full(len(member), -1)
        head[label[::-1]] = np.arange(len(member))[::-1]
        for step in range(width):
            if (codes[low + step] != codes[low[head[label]] + step]).any():
                # Two windows of one hash: tell them apart word by word.
                label = anchor[member]
                for each in range(width):
                    label, size, again = _classes(label, codes[low + each], place[member])
                break
        found = width
        while True:
            longest[member[again], first[member[again]]] = found
            # Those with company and another word may have a longer factor.
            on = (size > 1) & (lengths[member] - first[member] > found)
            if not on.any():
                break
            member, low = member[on], low[on]
            label, size, again = _classes(label[on], codes[low + found], place[member])
            found += 1
    return longest


def greedy_parse(longest: np.ndarray, windows: np.ndarray, width: int):
    """Factors ``(block, start, words)`` of a greedy parse, and those that start in windows cut by a factor's end."""
    at, parts = np.zeros(len(windows), np.int64), []
    while len(live := np.flatnonzero(at < windows)):
        size = longest[live, at[live]].astype(np.int64)
        hit = size > 0
        parts.append((live[hit], at[live][hit], size[hit]))
        at[live] += np.maximum(size, 1)
    block, start, size = (np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [()] * 3))
    cut = []
    for step in range(1, width):
        inside = start + size - width + step
        ok = (inside > start) & (inside < windows[block])
        b, i = block[ok], inside[ok]
        n = longest[b, i].astype(np.int64)
        cut.append((b[n > 0], i[n > 0], n[n > 0]))
    boundary = tuple(np.concatenate(c) if cut else np.zeros(0, np.int64) for c in (zip(*cut) if cut else [()] * 3))
    return (block, start, size), boundary


def _pack_blocks(symbols: runs.Symbols, low: np.ndarray, n: np.ndarray, anchor: np.ndarray, doc: np.ndarray,
                 start: np.ndarray, buckets: int, width: int) -> pa.RecordBatch:
    """Blocks with the codes of their words, one row per bucket."""
    to = (runs.mix(anchor) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, low, anchor, doc, start = to[order], low[order], anchor[order], doc[order], start[order]
    size = n[order] + width - 1
    ends = np.cumsum(size)
    codes = symbols.codes[np.repeat(low - (ends - size), size) + np.arange(size.sum())]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    payload = []
    for a, z in zip(cut, [*cut[1:], len(to)]):
        payload.append(b"".join([np.int64(z - a).tobytes(), anchor[a:z].tobytes(), doc[a:z].tobytes(),
                                 start[a:z].astype(np.int32).tobytes(), size[a:z].astype(np.int32).tobytes(),
                                 codes[ends[a] - size[a]:ends[z - 1]].tobytes()]))
    rows = len(cut)
    return pa.record_batch(
        [pa.array(to[cut], pa.int32()), pa.array(np.full(rows, firsts.BLOCK), pa.int32()),
         pa.array(np.zeros(rows), pa.int64()), pa.array(payload, pa.binary())], names=["bucket", "kind", "doc", "payload"])


def _unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    parts = []
    for p in payloads:
        count, at, columns = int(np.frombuffer(p, np.int64, 1)[0]), 8, []
        for kind in (np.uint64, np.int64, np.int32, np.int32):
            columns.append(np.frombuffer(p, kind, count, at))
            at += count * np.dtype(kind).itemsize
        parts.append([*columns, np.frombuffer(p, np.uint64, -1, at)])
    return [np.concatenate(c) for c in zip(*parts)]


def _factored(payloads: list[bytes], width: int, gram: int):
    """Marks of the factors of a bucket's blocks, whole anchors at a time."""
    anchor, doc, start, size, codes = _unpacked(payloads)
    begins = np.cumsum(size, dtype=np.int64) - size
    order = np.lexsort((start, doc, anchor))
    sorted_anchor = anchor[order]
    edge = np.append(np.flatnonzero(sorted_anchor[1:] != sorted_anchor[:-1]) + 1, len(order))
    a = 0
    while a < len(order):
        z = int(edge[min(np.searchsorted(edge, a + PIECE), len(edge) - 1)])
        part = order[a:z]
        d, s = doc[part], start[part].astype(np.int64)
        fresh = np.ones(len(part), np.int64)
        fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (anchor[part][1:] != anchor[part][:-1])
        lengths = size[part].astype(np.int64)
        ends = np.cumsum(lengths)
        words = codes[np.repeat(begins[part] - (ends - lengths), lengths) + np.arange(ends[-1])]
        longest = longest_factors(words, ends - lengths, lengths, anchor[part], np.cumsum(fresh), width, gram)
        for block, at, n in greedy_parse(longest, lengths - width + 1, width):
            if len(block):
                yield firsts.span_batch(firsts.MARK, d[block], s[block] + at, n - width + 1)
        a = z


def _checked(texts: DataFrame, spans: DataFrame, width: int, gram: int) -> DataFrame:
    """Marks from the blocks that are no factor as a whole: parsed by anchor, or window by window."""
    buckets = BUCKETS * partitions(texts.sparkSession)

    def dealt(batches):
        for batch in batches:
            data, offsets = runs.texts(batch)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at, kind, start, n, anchor = firsts.span_arrays(batch)
            hot = [[] for _ in range(5)]
            for a, z in runs.packs(offsets):
                symbols = runs.Symbols(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], True)
                part = slice(at[a], at[z])
                k, s, c = kind[part], start[part].astype(np.int64), n[part].astype(np.int64)
                owner = np.repeat(np.arange(z - a), np.diff(at[a:z + 1]))
                low = symbols.offsets[owner] + s
                direct, common = np.flatnonzero(k == firsts.BLOCK), np.flatnonzero(k == firsts.HOT)
                if len(direct):
                    yield _pack_blocks(symbols, low[direct], c[direct], anchor[part][direct].view(np.uint64),
                                       docs[a:z][owner[direct]].astype(np.int64), s[direct], buckets, width)
                if len(common):
                    c = c[common]
                    inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    one, other = _window_hashes(symbols.codes, np.repeat(low[common], c) + inside, width)
                    for column, x in zip(hot, (one, other, np.repeat(docs[a:z][owner[common]], c),
                                               (np.repeat(s[common], c) + inside).astype(np.int32),
                                               np.ones(len(inside), np.uint8))):
                        column.append(x)
            if hot[0]:
                yield from firsts.send([np.concatenate(c) for c in hot], firsts.WINDOW, buckets, None)

    def settle(batches):
        def resolved():
            for _, rows in firsts.by_bucket(batches):
                blocks = [p for r in rows for p in r.filter(pc.equal(r["kind"], firsts.BLOCK))["payload"].to_pylist()]
                if blocks:
                    yield from _factored(blocks, width, gram)
                others = [r.filter(pc.not_equal(r["kind"], firsts.BLOCK)) for r in rows]
                yield from firsts.receive([r for r in others if r.num_rows])

        yield from firsts.merged(resolved())

    checks = firsts.gathered(spans.filter(F.col("kind") != firsts.MARK))
    joined = texts.join(checks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "spans")
    packed = joined.mapInArrow(dealt, firsts.PACKED).repartition(partitions(texts.sparkSession), "bucket")
    return packed.sortWithinPartitions("bucket").mapInArrow(settle, firsts.SPANS)


def _window_hashes(codes: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows at ``place``."""
    one, other = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    for i in range(width):
        code = codes[place + i]
        one = one * np.uint64(0x9E3779B97F4A7C15) + code
        other = other * _SECOND + runs.mix(code ^ _SECOND)
    return runs.mix(one), runs.mix(other)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    Every word goes that a window of ``width`` words covers whose words also
    start earlier (smaller ``doc_id``, or same document and earlier start).
    Null and empty texts have no words; a document of fewer than ``width``
    words keeps them all. A document without an id takes no part and keeps its
    words. Rows that repeat an id with the same text give equal rows, and none
    of them counts as earlier than another; texts of one id should be equal.
    Other columns are ignored. An empty table gives an empty result. Without
    ``with_text`` the kept text is left out.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = texts.filter("doc_id is not null")
    spans = firsts.block_spans(known, True, gram, width, BUCKETS)
    repeats = spans.filter(F.col("kind") == firsts.MARK).unionByName(_checked(known, spans, width, gram))

    def finish(data, starts, counts):
        words = data.tobytes().split()
        kept = words
        if len(starts):
            gone = runs.cover(starts, counts, width, len(words))
            kept = list(compress(words, ~gone))
        text = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text if with_text else None

    out = firsts.rewrite(known, repeats, finish, _SCHEMA).unionByName(
        firsts.rewrite(texts.filter("doc_id is null"), None, finish, _SCHEMA))
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else out.drop("kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL: dict[str, str] = {}
