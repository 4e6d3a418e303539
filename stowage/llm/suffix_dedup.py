"""Removal of repeated byte strings through an enhanced suffix array.

All suffixes that start with the same anchor form one interval of the suffix
array of the whole corpus, so the array can be built interval by interval:
documents are cut into content-defined blocks and dealt by anchor (see
``firsts``). Equal whole blocks stand at the same places of
that order and are settled there by hash. The first block of each body, where
an anchor has several, brings its bytes; a task sorts the suffixes of its
blocks by prefix doubling, takes the common prefixes of neighbours from the
ranks, and scans them with a stack for the intervals of the common-prefix tree.
An interval of depth ``width`` or more whose occurrences differ in the byte to
their left is a maximal repeat (otherwise the interval one byte to the left
holds the same occurrences and covers it); all its occurrences but the first go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import firsts, runs
from stowage.llm.tables import documents, partitions

WIDTH = 100  # bytes of a repeated string
GRAM = 16  # bytes of an anchor
PIECE = 1 << 20  # bytes of blocks that are sorted at a time, if anchors allow
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_REGIONS = "bucket int, kind int, doc long, start int, region binary, anchor long, payload binary"


def suffix_array(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, windows: np.ndarray):
    """Enhanced suffix array over pieces of text: the first ``windows[i]`` suffixes of each piece ``i``.

    Piece ``i`` is ``data[begins[i]:begins[i] + lengths[i]]``, and no prefix
    reaches beyond it. Returns, in suffix order, the piece and the place in
    it of each suffix, and the common prefix with the suffix before.
    """
    # Every piece ends in a symbol of its own, so no two suffixes are equal.
    count = len(begins)
    heads = np.cumsum(lengths + 1) - lengths - 1
    piece = np.repeat(np.arange(count), lengths)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.empty(len(piece) + count, np.int64)
    rank[heads[piece] + inside] = data[begins[piece] + inside]
    rank[heads + lengths] = 256 + np.arange(count)
    levels, size, deepest = [(1, rank)], 1, int(lengths.max(initial=0)) + 1
    while size * 3 < deepest:
        # Ranks of runs several times as long, as many as fit into 62 bits.
        bits = int(rank.max()).bit_length()
        times = min(4, 62 // bits)
        key = rank.copy()
        for step in range(1, times):
            key <<= bits
            key[:-step * size] |= rank[step * size:]
        _, rank = np.unique(key, return_inverse=True)
        size *= times
        levels.append((size, rank.astype(np.int32)))
    chosen = inside < windows[piece]
    piece, inside = piece[chosen], inside[chosen]
    places = heads[piece] + inside
    last = len(rank) - 1
    order = np.lexsort([rank[np.minimum(places + step, last)] for step in range(0, deepest, size)][::-1])
    piece, inside, places = piece[order], inside[order], places[order]
    common = np.zeros(len(places), np.int64)
    one, other = places[:-1].copy(), places[1:].copy()
    for size, rank in reversed(levels):
        live = np.arange(len(one))
        while len(live):
            live = live[rank[one[live]] == rank[other[live]]]
            one[live] += size
            other[live] += size
    common[1:] = one - places[:-1]
    return piece, inside, common


def repeat_groups(common: np.ndarray, before: np.ndarray, first: np.ndarray, width: int):
    """Maximal repeats of ``width`` and more: a stack scan of the common-prefix interval tree.

    Takes, in suffix order, the common prefix with the suffix before, the
    byte to the left (-1 where there is none, which differs from any) and
    the place of each suffix among all in document order. Returns the groups
    ``(low, high, length)`` whose occurrences have different left neighbours
    (suffixes ``low`` to ``high``, all of them), and the repeats ``(suffix,
    length)``: each suffix that is not the first of some such group, once,
    with the greatest length for which it is not.
    """
    groups: list[tuple[int, int, int]] = []
    repeats: list[tuple[int, int]] = []
    near = np.flatnonzero(common >= width)
    if not len(near):
        return groups, repeats
    cut = np.flatnonzero(np.diff(near) > 1) + 1
    for run in np.split(near, cut):
        at = int(run[0]) - 1
        depths = common[run].tolist() + [0]
        lefts, firsts_ = before[at:at + len(depths)].tolist(), first[at:at + len(depths)].tolist()
        stack: list[list] = []  # depth, low, first suffix as (place, suffix), left byte, suffixes beaten here
        for i, depth in enumerate(depths):
            low, best, left = at + i, (firsts_[i], at + i), lefts[i]
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                _absorb(top, best, left)
                length, low, best, left, beaten = top
                if left < 0:
                    groups.append((low, at + i, length))
                    repeats.extend((suffix, length) for _, suffix in beaten)
            if stack and stack[-1][0] == depth:
                _absorb(stack[-1], best, left)
            elif depth:
                stack.append([depth, low, best, left, []])
    return groups, repeats


def _absorb(interval: list, best: tuple[int, int], left: int) -> None:
    """Add a closed interval or a suffix: the smaller first occurrence stays, different left bytes become -1."""
    if best < interval[2]:
        best, interval[2] = interval[2], best
    if best[0] != interval[2][0]:
        interval[4].append(best)
    if left != interval[3]:
        interval[3] = -1


def _sort_regions(doc: np.ndarray, start: np.ndarray, regions: list[bytes], width: int):
    """Spans of all repeats but the first occurrence of each group."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    lengths = np.array([len(r) for r in regions], np.int64)
    begins = np.cumsum(lengths) - lengths
    piece, inside, common = suffix_array(data, begins, lengths, lengths - width + 1)
    before = np.where(inside > 0, data[np.maximum(begins[piece] + inside - 1, 0)].astype(np.int64), -1)
    at = start.astype(np.int64)[piece] + inside
    order = np.lexsort((at, doc[piece]))
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = (np.diff(doc[piece][order]) != 0) | (np.diff(at[order]) != 0)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh)
    _, repeats = repeat_groups(common, before, place, width)
    found = np.array(repeats, np.int64).reshape(-1, 2)
    return doc[piece[found[:, 0]]], at[found[:, 0]], found[:, 1] - width + 1


def _checked(texts: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Marks from the blocks whose windows need a check."""
    buckets = firsts.BUCKETS * partitions(texts.sparkSession)

    def regions(batches):
        for batch in batches:
            data, offsets = runs.texts(batch)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at, kind, start, n, anchor = firsts.span_arrays(batch)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            low = offsets[owner] + start
            high = low + n + width - 1
            direct = np.flatnonzero(kind == firsts.BLOCK)
            key = anchor[direct].view(np.uint64)
            to = (runs.mix(key) % np.uint64(buckets)).astype(np.int32)
            nothing = pa.nulls(len(direct), pa.binary())
            yield pa.record_batch(
                [pa.array(to), pa.array(np.full(len(direct), firsts.BLOCK), pa.int32()),
                 pa.array(docs[owner[direct]], pa.int64()), pa.array(start[direct].astype(np.int32)),
                 pa.array([data[a:z].tobytes() for a, z in zip(low[direct], high[direct])], pa.binary()),
                 pa.array(anchor[direct], pa.int64()), nothing],
                names=["bucket", "kind", "doc", "start", "region", "anchor", "payload"])
            hot = np.flatnonzero(kind == firsts.HOT)
            for i in range(0, len(hot), 10_000):
                for packed in _hashed(data, docs[owner[hot[i:i + 10_000]]], start[hot[i:i + 10_000]],
                                      low[hot[i:i + 10_000]], n[hot[i:i + 10_000]].astype(np.int64)):
                    rows = packed.num_rows
                    yield pa.record_batch(
                        [packed.column("bucket"), packed.column("kind"), packed.column("doc"),
                         pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()),
                         packed.column("payload")],
                        names=["bucket", "kind", "doc", "start", "region", "anchor", "payload"])

    def _hashed(data, doc, start, low, n):
        """Windows of anchors that are too common for one task, by hash."""
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = low[owner] + inside
        one, other = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        second = runs.mix(runs.BYTE_CODES)
        for i in range(width):
            byte = data[place + i]
            one = one * np.uint64(0x9E3779B97F4A7C15) + runs.BYTE_CODES[byte]
            other = other * np.uint64(0xD1B54A32D192ED03) + second[byte]
        columns = [runs.mix(one), runs.mix(other), doc[owner], (start[owner] + inside).astype(np.int32),
                   np.ones(len(place), np.uint8)]
        yield from firsts.send(columns, firsts.WINDOW, buckets, None)

    def settle(batches):
        def pieces(rows):
            """Blocks of whole anchors, about ``PIECE`` bytes at a time."""
            table = pa.Table.from_batches([r for r in rows if r.num_rows])
            table = table.filter(pc.equal(table["kind"], firsts.BLOCK)).sort_by("anchor")
            if not table.num_rows:
                return
            anchor = table["anchor"].to_numpy()
            size = np.cumsum(pc.binary_length(table["region"]).to_numpy())
            edge = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
            a = 0
            while a < len(anchor):
                reach = np.searchsorted(size, (size[a - 1] if a else 0) + PIECE)
                z = int(edge[np.searchsorted(edge, max(reach, a + 1))]) if reach < len(anchor) else len(anchor)
                yield table.slice(a, z - a)
                a = z

        def resolved():
            for _, rows in firsts.by_bucket(batches):
                for part in pieces(rows):
                    doc, start, n = _sort_regions(part["doc"].to_numpy(), part["start"].to_numpy(),
                                                  part["region"].to_pylist(), width)
                    yield firsts.span_batch(firsts.MARK, doc, start, n)
                others = [r.filter(pc.not_equal(r["kind"], firsts.BLOCK)) for r in rows]
                yield from firsts.receive([r for r in others if r.num_rows])

        yield from firsts.merged(resolved())

    checks = firsts.gathered(spans.filter(F.col("kind") != firsts.MARK)).hint("shuffle_hash")
    joined = texts.join(checks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "spans")
    dealt = joined.mapInArrow(regions, _REGIONS).repartition(partitions(texts.sparkSession), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(settle, firsts.SPANS)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte of the UTF-8 text goes that a string of ``width`` bytes covers
    which also starts earlier (smaller ``doc_id``, or same document and earlier
    start); ``n_spans`` counts the maximal removed runs and ``kept`` is what is
    left (bytes, since a cut may divide a character). Null and empty texts have
    no bytes; a text shorter than ``width`` stays whole. A document without an
    id takes no part and stays whole. Rows that repeat an id with the same text
    give equal rows, and none of them counts as earlier than another; texts of
    one id should be equal. Other columns are ignored. An empty table gives an
    empty result. Without ``with_text`` the kept bytes are left out.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    known = texts.filter("doc_id is not null")
    spans = firsts.block_spans(known, False, gram, width)
    repeats = spans.filter(F.col("kind") == firsts.MARK).unionByName(_checked(known, spans, width))

    def finish(data, starts, counts):
        gone = runs.cover(starts, counts, width, len(data)) if len(starts) else np.zeros(len(data), bool)
        kept = (data[~gone] if len(starts) else data).tobytes()
        opened = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
        return len(data), len(data) - len(kept), opened, hashlib.sha256(kept).hexdigest(), kept if with_text else None

    out = firsts.rewrite(known, repeats, finish, _SCHEMA).unionByName(
        firsts.rewrite(texts.filter("doc_id is null"), None, finish, _SCHEMA))
    return out if with_text else out.drop("kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL: dict[str, str] = {}
