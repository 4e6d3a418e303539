"""First occurrences of equal windows over all documents, in two shuffles of packed records.

A task packs its blocks (see ``runs``) into binary records dealt by anchor.
Whoever receives an anchor has all blocks with it: of blocks with equal bodies
all but the first repeat earlier text. Blocks that share an anchor but differ
in body may still share single windows; the first of each body goes to a check
of its windows, which the operators supply.

No task holds a group that grows with the copies: a task sends one record per
body however many copies it has read, and anchors met in very many bodies (a
line common to a large part of the corpus) are dealt by body instead and
always checked by window. Those anchors are found by counters over all blocks;
at most a few per shuffle partition can exceed the limit, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import runs
from stowage.llm.tables import partitions
from stowage.session import materialize

FLUSH = 1 << 20  # blocks held by a task before it packs them
BUCKETS = 16  # packing buckets per shuffle partition: more are dealt more evenly, but make more and smaller records
COUNTERS = 4096  # anchor counters a task hands on

BLOCK, MARK, HOT, WINDOW = 0, 1, 2, 3
PACKED = "bucket int, kind int, doc long, payload binary"
SPANS = "kind int, doc long, start int, n int, anchor long"
_RECORD = (np.uint64, np.uint64, np.int64, np.int32, np.uint8)


def _columns(*parts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate(p) if p else np.zeros(0) for p in parts]


def _first_of_class(key: np.ndarray, body: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Order by class and place; marks of the first row of each (key, body). A place given twice is taken once."""
    order = np.lexsort((start, doc, body, key))
    k, b, d, s = key[order], body[order], doc[order], start[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    fresh = head.copy()
    fresh[1:] |= (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return order[fresh], head[fresh]


def _block_batches(batches, by_word: bool, k: int, width: int) -> Iterator[list[np.ndarray]]:
    """Blocks of the task's documents: anchor, body, doc, start, n; about ``FLUSH`` at a time."""
    parts, held = [[] for _ in _RECORD], 0
    for batch in batches:
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, offsets = runs.texts(batch)
        for a, z in runs.packs(offsets):
            symbols = runs.Symbols(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a], by_word)
            for anchor, body, owner, start, count in symbols.blocks(k, width):
                for part, x, kind in zip(parts, (anchor, body, docs[a:z][owner], start, count), _RECORD):
                    part.append(x.astype(kind, copy=False))
                held += len(anchor)
            if held >= FLUSH:
                yield _columns(*parts)
                parts, held = [[] for _ in _RECORD], 0
    if held:
        yield _columns(*parts)


def _packed(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with the records of the bucket, column by column."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    ends = np.append(cut[1:], len(bucket))
    payload = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(cut, ends)]
    n = len(cut)
    return pa.record_batch(
        [pa.array(bucket[cut], pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.zeros(n), pa.int64()),
         pa.array(payload, pa.binary())], names=["bucket", "kind", "doc", "payload"])


def _local_marks(doc: np.ndarray, start: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per document with its repeated spans."""
    order = np.argsort(doc, kind="stable")
    doc, start, n = doc[order], start[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, int)
    ends = np.append(cut[1:], len(doc))
    payload = [start[a:z].tobytes() + n[a:z].tobytes() for a, z in zip(cut, ends)]
    to = runs.mix(doc[cut].astype(np.uint64)) % np.uint64(buckets)
    return pa.record_batch(
        [pa.array(to.astype(np.int32)), pa.array(np.full(len(cut), MARK), pa.int32()), pa.array(doc[cut], pa.int64()),
         pa.array(payload, pa.binary())], names=["bucket", "kind", "doc", "payload"])


def send(columns: list[np.ndarray], kind: int, buckets: int, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Pack records for their buckets; repeats seen within the task become marks at once."""
    key, body, doc, start, n = columns
    order, head = _first_of_class(key, body, doc, start)
    rest = order[~head]
    if len(rest):
        yield _local_marks(doc[rest], start[rest], n[rest], buckets)
    columns = [c[order[head]] for c in columns]
    key, body = columns[0], columns[1]
    spread = runs.mix(key ^ (body * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(buckets)
    if kind == WINDOW:
        yield _packed(spread.astype(np.int32), WINDOW, columns)
        return
    is_hot = np.isin(key, hot)
    direct = (runs.mix(key) % np.uint64(buckets)).astype(np.int32)
    for chosen, what, to in ((~is_hot, BLOCK, direct), (is_hot, HOT, spread.astype(np.int32))):
        if chosen.any():
            yield _packed(to[chosen], what, [c[chosen] for c in columns])


def span_batch(kind: int, doc, start, n, anchor=None) -> pa.RecordBatch:
    size = len(doc)
    anchor = np.zeros(size, np.int64) if anchor is None else anchor.view(np.int64)
    return pa.record_batch(
        [pa.array(np.full(size, kind), pa.int32()), pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)),
         pa.array(n.astype(np.int32)), pa.array(anchor, pa.int64())], names=["kind", "doc", "start", "n", "anchor"])


def _unpack(payloads: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in _RECORD)
    parts = [[] for _ in _RECORD]
    for p in payloads:
        count, at = len(p) // width, 0
        for part, t in zip(parts, _RECORD):
            part.append(np.frombuffer(p, t, count, at))
            at += count * np.dtype(t).itemsize
    return _columns(*parts)


def by_bucket(batches) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a task sorted by bucket, bucket by bucket."""
    held, current = [], None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
        for a, z in zip(cut, [*cut[1:], len(bucket)]):
            if bucket[a] != current and held:
                yield current, held
                held = []
            current = bucket[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield current, held


def receive(batches) -> Iterator[pa.RecordBatch]:
    """Resolve the buckets of a task: marks, and blocks whose windows need a check."""
    for _, rows in by_bucket(batches):
        payloads: dict[int, list] = {BLOCK: [], HOT: [], WINDOW: []}
        for batch in rows:
            for kind, doc, payload in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc", "payload"))):
                if kind == MARK:
                    count = len(payload) // 5
                    yield span_batch(MARK, np.full(count, doc), np.frombuffer(payload, np.int32, count),
                                 np.frombuffer(payload, np.uint8, count, 4 * count))
                else:
                    payloads[kind].append(payload)
        for kind, packed in payloads.items():
            if not packed:
                continue
            key, body, doc, start, n = _unpack(packed)
            order, head = _first_of_class(key, body, doc, start)
            rest = order[~head]
            if len(rest):
                yield span_batch(MARK, doc[rest], start[rest], n[rest])
            first = order[head]
            if kind == WINDOW:
                continue
            if kind == BLOCK:
                _, at, classes = np.unique(key[first], return_inverse=True, return_counts=True)
                first = first[classes[at] > 1]
            if len(first):
                yield span_batch(kind, doc[first], start[first], n[first], key[first])


def merged(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def exchange(packed: DataFrame) -> DataFrame:
    """Packed rows to the tasks of their buckets, and resolved there."""
    dealt = packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: merged(receive(batches)), SPANS)


def hot_anchors(texts: DataFrame, by_word: bool, k: int, width: int) -> np.ndarray:
    """Anchors with more bodies than a quarter of a shuffle partition's share of all blocks.

    Only balance depends on them, never the result.
    """
    def count(batches):
        total, held = 0, {}
        for key, body, *_ in _block_batches(batches, by_word, k, width):
            total += len(key)
            pair = np.unique(np.stack([key, body], 1), axis=0)[:, 0] if len(key) < 4096 else key[
                np.unique(runs.mix(key ^ (body * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]]
            anchors, counts = np.unique(pair, return_counts=True)
            several = counts > 1
            for a, c in zip(anchors[several].tolist(), counts[several].tolist()):
                held[a] = held.get(a, 0) + c
            if len(held) > COUNTERS:
                least = sorted(held.values(), reverse=True)[COUNTERS]
                held = {a: c for a, c in held.items() if c > least}
        yield pa.record_batch([pa.array([None, *(np.array(list(held), np.uint64).view(np.int64).tolist())], pa.int64()),
                               pa.array([total, *held.values()], pa.int64())], names=["anchor", "n"])

    counted = texts.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "anchors")
    total = counted.filter("anchor is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(total // (4 * partitions(texts.sparkSession)), 64)
    hot = [r.anchor for r in counted.filter((F.col("n") > limit) & F.col("anchor").isNotNull()).select("anchor").collect()]
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def block_spans(texts: DataFrame, by_word: bool, k: int, width: int, per_partition: int = BUCKETS) -> DataFrame:
    """Marked spans (``MARK``) and spans whose windows need a check (``BLOCK``, ``HOT``), stored."""
    hot = hot_anchors(texts, by_word, k, width)
    buckets = per_partition * partitions(texts.sparkSession)

    def pack(batches):
        for columns in _block_batches(batches, by_word, k, width):
            yield from send(columns, BLOCK, buckets, hot)

    return materialize(exchange(texts.mapInArrow(pack, PACKED)), "spans")


def gathered(spans: DataFrame) -> DataFrame:
    """The spans of each document in one array; a document has no more of them than symbols."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "n", "anchor")).alias("spans"))


def span_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Offsets, kind, start, n, anchor of the ``spans`` column; a null has none."""
    column = batch.column("spans")
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    fields = [values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
    return (np.concatenate(([0], np.cumsum(lengths))), *fields)


def rewrite(texts: DataFrame, marks: DataFrame | None, finish: Callable, schema: str) -> DataFrame:
    """Join each document with its marked spans and let ``finish(text, starts, counts)`` make its row."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            data, offsets = runs.texts(batch)
            at, _, start, n, _ = span_arrays(batch)
            for a, z in runs.packs(offsets, 8 * runs.SLICE):
                rows = [finish(data[offsets[i]:offsets[i + 1]], start[at[i]:at[i + 1]], n[at[i]:at[i + 1]])
                        for i in range(a, z)]
                columns = [pa.array(c, arrow[k]) for c, k in zip(zip(*rows), kinds[1:])]
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), *columns], names=list(names))

    if marks is None:
        empty = "cast(array() as array<struct<kind: int, start: int, n: int, anchor: bigint>>)"
        return texts.withColumn("spans", F.expr(empty)).mapInArrow(run, schema)
    joined = texts.join(gathered(marks).hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)
