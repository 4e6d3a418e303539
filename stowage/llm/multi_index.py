"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012).

Vectors are cut into two halves, each with a codebook of its own; a cell is a
pair of centroids. A query visits cells in the order of the sum of the two
squared distances, which a heap yields without looking at all pairs, until the
cells it has seen hold enough entries. The entries are ranked by their exact
distance, in blocks of entries whose first centroids are in one group.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.tables import drawn, partitions
from stowage.session import materialize

SAMPLE = 20_000  # vectors that the codebooks are fitted on, at most
CODES = 512  # centroids of a half, at most; otherwise as many as the square root of the number of entries
SHARE = 0.4  # of all entries, to visit for a query: vectors without clusters need that for a recall above 0.9
LEAST = 40  # entries to visit at least for each neighbour asked for: no share of a handful of entries holds the nearest
BLOCK = 1 << 14  # entries, and queries, that meet in one block at most (about)
GROUPS = 16  # of first centroids, at most: a block gives each of its queries up to ten neighbours
NEIGHBOURS = 10
EVERY = 100  # rows with an id divisible by this are the queries
SEED = 23


@dataclass
class Codebooks:
    """Centroids of both halves and the number of entries in each cell."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Squared distances of the halves of each vector to the centroids."""
        cut, out = self.halves[0].shape[1], []
        for part, book in zip((vectors[:, :cut], vectors[:, cut:]), self.halves):
            out.append((part ** 2).sum(axis=1)[:, None] - 2 * part @ book.T + (book ** 2).sum(axis=1))
        return out

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(axis=1) for d in self.distances(vectors))
        return first * len(self.halves[1]) + second

    def visit(self, first: np.ndarray, second: np.ndarray, entries: int) -> list[int]:
        """Cells in the order of summed distance until they hold ``entries`` entries (the multi-sequence algorithm)."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        heap, seen, out, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and held < entries:
            _, i, j = heapq.heappop(heap)
            cell = int(a[i]) * len(b) + int(b[j])
            if self.counts[cell]:
                out.append(cell)
                held += int(self.counts[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0))
    return rows


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def build(rows: DataFrame, sample: int = SAMPLE, codes: int = CODES) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks from a bounded sample, and every row with its ``cell``, stored. ``rows`` must be a stored table."""
    fitted = drawn(rows, sample, SEED, "vec_id").select("vector").collect()
    if not fitted:
        return None, rows.withColumn("cell", F.lit(0))
    x = np.array([r.vector for r in fitted])
    k = max(1, min(codes, math.isqrt(rows.count()), len(x) // 4))
    cut = max(1, x.shape[1] // 2)
    books = Codebooks((_kmeans(x[:, :cut], k), _kmeans(x[:, cut:], k) if x.shape[1] > cut else np.zeros((1, 0))),
                      np.zeros(0, np.int64))

    def placed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                at = books.cells(_stack(part)).astype(np.int32)
                yield pa.record_batch([*part.columns, pa.array(at)], names=[*part.schema.names, "cell"])

    return books, materialize(rows.mapInArrow(placed, "vec_id long, vector array<double>, cell int"), "cells")


_FOUND = ["query_id", "twin", "vec_id", "score"]
_NONE = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _nearest(queries: pa.Table, entries: pa.Table, neighbours: int) -> pa.Table:
    """The nearest visited entries of each query of a block."""
    if not queries.num_rows or not entries.num_rows:  # a block that only one side has
        return pa.table(_NONE, names=_FOUND)

    def matrix(table):
        column = table["vector"].combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    ids, points = entries["vec_id"].to_numpy(), matrix(entries)
    cells, places = np.unique(entries["cell"].to_numpy(), return_inverse=True)
    asked, vectors, visited = queries["query_id"].to_numpy(), matrix(queries), queries["cells"]
    twins = queries["twin"].to_numpy()
    size = (points ** 2).sum(axis=1)
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    out = []
    for i, query in enumerate(vectors):
        open_entries = np.isin(cells, visited[i].values.to_numpy())[places]
        # The query's own row is one with its id and its vector; other rows of that id are candidates.
        same = by_id[np.searchsorted(sorted_ids, asked[i]):np.searchsorted(sorted_ids, asked[i], "right")]
        open_entries[same[(points[same] == query).all(axis=1)][:1]] = False
        near = np.flatnonzero(open_entries)
        if not len(near):
            continue
        # The expanded square picks who can be among the nearest; the measure itself decides.
        rough = size[near] - 2 * points[near] @ query
        if len(near) > neighbours:
            border = np.partition(rough, neighbours - 1)[neighbours - 1]
            near = near[rough <= border + 1e-9 * (abs(border) + size.max() + query @ query)]
        exact = np.sqrt(((points[near] - query) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact))[:neighbours]
        out.append((np.full(len(order), asked[i]), np.full(len(order), twins[i]), ids[near][order], exact[order]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else _NONE
    return pa.table(columns, names=_FOUND)


def search(vectors: DataFrame, every: int = EVERY, neighbours: int = NEIGHBOURS, share: float = SHARE,
           sample: int = SAMPLE, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """The nearest neighbours of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; every other
    row is a candidate. ``score`` is the Euclidean distance in double precision.
    Ranks run from 1, ties go to the smaller id; a query with fewer candidates
    gets them all. Rows without an id, and vectors that are null, empty, zero or
    hold a null or a component that is not finite take no part, nor do vectors
    of another length than the commonest. Of equal vectors no more than can be
    reported (the smallest ids) are compared. Rows that share an id are
    candidates each, and queries by their vector: rows alike in both are one
    query, which finds the others; rows that differ in the vector are ranked
    apart under the one id. Other columns are ignored; an empty table gives an
    empty result.

    Each query visits ``share`` of the entries but at least ``LEAST`` for each
    neighbour, so the result is exact where there are no more entries than that.
    """
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (lengths.n if lengths else 0))
    books, index = build(materialize(rows, "vectors"), sample, codes)
    if books is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    width = len(books.halves[1])

    # Equal vectors share all distances: the smallest ids are enough, whatever their number. The ranks are
    # limited by map tasks before the shuffle, so a vector that very many rows have is not gathered.
    equal = Window.partitionBy("cell", "vector").orderBy("vec_id")
    entry = materialize(index.withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= neighbours + 1)
                        .drop("_n"), "entries")
    books.counts = np.zeros(len(books.halves[0]) * width, np.int64)
    for r in entry.groupBy("cell").count().collect():  # at most ``codes`` squared
        books.counts[r.cell] = r["count"]
    total = int(books.counts.sum())
    enough = max(LEAST * neighbours, math.ceil(share * total))
    # Blocks of bounded size: the entries of a group of first centroids, and the queries that visit it, in so many parts
    # each. There are no more groups with more centroids, so what the blocks give grows with the queries alone.
    groups = min(GROUPS, len(books.halves[0]))
    by_first = books.counts.reshape(-1, width).sum(axis=1)
    entry_parts = [int(-(-by_first[g::groups].sum() // block)) or 1 for g in range(groups)]
    queries = materialize(index.filter(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct()
                          .withColumn("twin", F.xxhash64("vector")), "queries")
    query_parts = -(-queries.count() // block) or 1

    def probes(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                first, second = books.distances(_stack(one))
                seen = np.array(books.visit(first[0], second[0], enough), np.int64)
                part = hash(int(one.column("vec_id")[0].as_py())) % query_parts
                at_group = seen // width % groups
                keys, lists = [], []
                for group in np.unique(at_group):
                    for p in range(entry_parts[group]):
                        keys.append((int(group), p, part))
                        lists.append(seen[at_group == group])
                at = pa.array(np.zeros(len(keys), np.int64))
                yield pa.record_batch(
                    [*(pa.array(k, pa.int32()) for k in zip(*keys)), one.column("vec_id").take(at),
                     one.column("vector").take(at), one.column("twin").take(at), pa.array(lists, pa.list_(pa.int32()))],
                    names=["code_group", "entry_part", "query_part", "query_id", "vector", "twin", "cells"])

    # Few rows with much work each: read as one split they would be one task.
    asked = queries.repartition(partitions(rows.sparkSession), "vec_id").mapInArrow(
        probes, "code_group int, entry_part int, query_part int, query_id long, vector array<double>, twin long, "
                "cells array<int>")
    group = F.pmod(F.floor(F.col("cell") / width), F.lit(groups)).cast("int")
    parts = F.element_at(F.array(*[F.lit(n) for n in entry_parts]), group + 1)
    kept = entry.select(
        group.alias("code_group"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("entry_part"),
        F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("query_part"), "vec_id", "vector", "cell")

    keys = ["code_group", "entry_part", "query_part"]
    near = asked.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(
        lambda q, e: _nearest(q, e, neighbours), "query_id long, twin long, vec_id long, score double")
    best = Window.partitionBy("query_id", "twin").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours).select(
        "query_id", "rank", "vec_id", "score")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_multi_index": op4_multi_index}
SQL: dict[str, str] = {}
