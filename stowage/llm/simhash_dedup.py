"""Near-duplicate documents by SimHash, found through Golay codewords.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in
at most three bits, at least two of the segments differ in at most one bit each
(two segments with two errors would make four). In the perfect binary Golay
code of length 23 every word is at most three bits from exactly one codeword,
so of two segments at most one bit apart, the codeword next to either is at
most four bits from the other. A segment thus has one *own* codeword and one or
six *near* ones (all within four bits), and each side's own codeword is among
the near ones of the other. Two segments make a key: one side takes (near, own),
the other (own, near), and every pair within three bits shares a key of one
segment pair. Shared keys are verified by bit count.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import runs
from stowage.llm.graph import components
from stowage.llm.tables import documents
from stowage.session import materialize

SHINGLE = 3  # words
DISTANCE = 3  # differing bits that still link
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and bits of each segment
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
WORD_BITS, DATA_BITS, RADIUS = 23, 12, 4


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 11-bit remainder's leader, and the codewords near each coset.

    Returns the 23 syndromes of single bits, the leader of each syndrome, and
    for each syndrome the up to six error patterns of weight at most four
    (padded with the leader), with their number.
    """
    unit = np.zeros(WORD_BITS, np.int64)
    for bit in range(WORD_BITS):
        rest = 1 << bit
        for high in range(WORD_BITS - 1, WORD_BITS - DATA_BITS - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - (WORD_BITS - DATA_BITS))
        unit[bit] = rest
    near: list[list[int]] = [[] for _ in range(1 << (WORD_BITS - DATA_BITS))]
    todo = [(0, 0, 0, 0)]
    while todo:
        pattern, syndrome, weight, low = todo.pop()
        near[syndrome].append(pattern)
        if weight < RADIUS:
            todo += [(pattern | 1 << b, syndrome ^ int(unit[b]), weight + 1, b + 1) for b in range(low, WORD_BITS)]
    near = [sorted(p, key=lambda x: (x.bit_count(), x)) for p in near]
    count = np.array([len(p) for p in near])
    table = np.array([p + [p[0]] * (count.max() - len(p)) for p in near], np.int64)
    return unit, table[:, 0], table, count


def syndromes(words: np.ndarray) -> np.ndarray:
    unit = golay()[0]
    out = np.zeros(len(words), np.int64)
    for bit in range(WORD_BITS):
        out ^= np.where(words >> bit & 1, unit[bit], 0)
    return out


def _segment(prints: np.ndarray, number: int) -> np.ndarray:
    first, bits = SEGMENTS[number]
    return (prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)


def search_keys(prints: np.ndarray, near_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint, as (row number, key)."""
    _, leader, table, count = golay()
    own, near, several = [], [], []
    for number in range(3):
        word = _segment(prints, number)
        s = syndromes(word)
        own.append(word ^ leader[s])
        near.append(word[:, None] ^ table[s])
        several.append(count[s])
    rows, keys = [], []
    for pair, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        wide, single = (x, y) if near_first else (y, x)
        valid = np.arange(near[wide].shape[1]) < several[wide][:, None]
        row = np.nonzero(valid)[0]
        a, b = near[wide][valid], own[single][row]
        first, second = (a, b) if near_first else (b, a)
        rows.append(row)
        keys.append((first << WORD_BITS | second) * 3 + pair)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a lower-cased text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    end = end.tolist()[shingle - 1:] or [len(joined)]
    hashed = xxhash.xxh64_intdigest
    values = np.fromiter((hashed(joined[a:z], SEED) for a, z in zip(begin, end)), np.uint64, len(end))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint's bits as a signed long) of each row."""
    def run(batches):
        for batch in batches:
            data, offsets = runs.texts(batch)
            whole = data.tobytes()
            prints = np.array([fingerprint(whole[a:z], shingle) for a, z in zip(offsets, offsets[1:])], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at most ``distance`` (3 or fewer) bits apart."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys find all pairs up to a distance of 3")

    def keyed(near_first: bool, name: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                values = batch.column("print").to_numpy()
                row, key = search_keys(values, near_first)
                yield pa.record_batch([pa.array(key), pa.array(values[row])], names=["key", name])
        return prints.mapInArrow(run, f"key long, {name} long")

    pairs = keyed(True, "a").join(keyed(False, "b"), "key")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return pairs.filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; documents of
    fewer than ``shingle`` words have one shingle, those without words (null
    and empty texts too) the fingerprint zero, which links like any other.
    Equal fingerprints count as one node, so copies make no pairs. The
    ``component_id`` is the smallest id that links reach; ids that are null
    come last, and a component of null ids alone has a null one. Repeated rows
    give equal rows. Other columns are ignored; an empty table gives an empty
    result.
    """
    members = materialize(fingerprints(docs, shingle), "prints")
    nodes = materialize(members.groupBy("print").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes.select("print"), distance))
    roots = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "low", F.coalesce("root", "print").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(smallest, "root").select("print", "component_id")
    return members.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest id.

    Of rows that repeat that id one stays. A row without an id stays, as no
    decision can name it.
    """
    groups = near_duplicates(docs, shingle, distance)
    name = "kept_id"
    while name in docs.columns:
        name += "_"
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    known = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col(name))
    one = known.drop(name).dropDuplicates(["doc_id"])
    return one.unionByName(docs.filter("doc_id is null"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_simhash_dedup": op10_simhash_dedup}
SQL: dict[str, str] = {}
