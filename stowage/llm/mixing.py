"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is more
than its size repeats whole (twice or three times); what is left of the target
is a subset-sum problem over the length counts: every length gives its share of
the budget in whole documents, spare ones follow from the longest down, and the
last stretch is fitted by bounded-knapsack dynamic programming over the lengths
still to be had. Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm.tables import documents, numbered, sizes
from stowage.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3  # a target, and what is taken of a document, in sizes
SEED = 17
STRETCH = 1 << 14  # words of budget left to the dynamic programme
BIN = 128  # documents of one length among which the border is looked for, about
SMALL = 1 << 17  # decisions that may be broadcast (a hundred bytes each)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``: shares by weight, none above ``cap`` sizes.

    Sources are ranked by code point, null last. What is above a cap is shared
    among the rest by weight, again until none is above.
    """
    ranked = sources.select("source", "source_size", F.col("source").isNull().alias("_last"))
    ranked = materialize(numbered(ranked, [], ["_last", "source"], "_rank"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", F.col("source_size"), weight.alias("_weight"))
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = F.col("source_size") * float(cap)
    level, met = 0.0, F.lit(False)
    while True:
        # Sources at their cap are those that the last level has filled; two sums come to the driver.
        free, spent = ranked.agg(F.sum(F.when(~met, F.col("_weight"))), F.sum(F.when(met, most))).first()
        if not free or (whole - (spent or 0.0)) / free <= level:
            break
        level = (whole - (spent or 0.0)) / free
        met = F.col("_weight") * level >= most
    target = F.when(met, most).otherwise(F.col("_weight") * level)
    return ranked.select("source", "source_size", target.alias("target"))


def fit(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length sum up to ``budget``, or as near as the last stretch allows."""
    order = np.argsort(-length, kind="stable")
    length, count = length[order].astype(np.int64), count[order].astype(np.int64)
    whole = int((length * count).sum())
    taken = np.zeros(len(length), np.int64)
    useful = length > 0
    if whole and budget > 0:
        share = min(1.0, max(0.0, budget - STRETCH) / whole)
        taken[useful] = np.floor(count[useful] * share).astype(np.int64)
    left = budget - int((length * taken).sum())
    for i in np.flatnonzero(useful):
        more = min(count[i] - taken[i], max(0, left - STRETCH) // length[i])
        taken[i] += more
        left -= int(more * length[i])
    # Bounded knapsack on the rest: bit s of ``reach`` says that s words can be had.
    steps, reach, full = [], 1, (1 << max(left, 0) + 1) - 1
    for i in np.flatnonzero(useful & (length <= left) & (taken < count)):
        spare, many = int(min(count[i] - taken[i], left // length[i])), 1
        while spare and not reach >> left & 1:
            many = min(many, spare)
            steps.append((i, many, reach))
            reach |= reach << int(length[i]) * many & full
            spare, many = spare - many, many * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, many, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += many
            at -= int(length[i]) * many
    # One document more, if that ends nearer to the budget.
    left = budget - int((length * taken).sum())
    spare = np.flatnonzero(useful & (taken < count))
    if left > 0 and len(spare):
        best = spare[np.argmin(np.abs(length[spare] - left))]
        taken[best] += abs(int(length[best]) - left) < left
    out = np.empty(len(length), np.int64)
    out[order] = taken
    return out


def _draw(doc_id: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id)


def _unit() -> list[Column]:
    return [sizes(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("tie")]


def decisions(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For each (source, size): size of the source, target, whole repeats, and the last draw taken once more.

    ``units`` has ``doc_id, source, size`` and ``tie``, a number that tells
    rows apart. A document is drawn by a hash of its id; of the documents of
    one source and size the first so many in the order of (draw, id, tie) are
    taken once more than the rest.
    """
    lengths = materialize(units.groupBy("source", "size").agg(F.count("*").alias("count")), "lengths")
    source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).cast("long").alias("source_size"))
    goal = materialize(targets(source, weights, cap), "targets")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        repeats = min(cap, int(target // size)) if size else 0
        budget = int(round(target - repeats * size)) if repeats < cap else 0
        more = fit(part["size"].to_numpy(), part["count"].to_numpy(), budget)
        return part.assign(repeats=repeats, more=more)

    # A source has fewer lengths than the square root of twice its words: one small group for each.
    schema = "source string, size long, count long, source_size long, target double, repeats int, more long"
    named = lengths.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = materialize(named.groupBy("source").applyInPandas(fitted, schema), "plan")

    # The border draw of each length: first its bin, by counts, then its place within the bin.
    part = plan.filter("more > 0 and more < count").select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("count").alias("_c"), "more")
    key = (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("size") == F.col("_z"))
    bins = F.ceil(F.col("_c") / BIN)
    drawn = units.join(part, key).select(
        "source", "size", "more", "doc_id", "tie", _draw(F.col("doc_id")).alias("draw"), bins.alias("bins"))
    # The upper 32 bits of the draw, as a share of all; monotonic in the draw.
    share = (F.shiftright("draw", 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    drawn = materialize(drawn.withColumn("bin", F.floor(share * F.col("bins"))).drop("bins"), "draws")
    counted = drawn.groupBy("source", "size", "bin").agg(F.count("*").alias("n"), F.first("more").alias("more"))
    upto = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    border = counted.filter("before < more and before + n >= more").select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("bin").alias("_b"),
        (F.col("more") - F.col("before")).alias("rest"))
    inside = drawn.join(border, key & (F.col("bin") == F.col("_b")))
    # Over ranges, as rows that share an id share a bin, whatever their number.
    placed = numbered(inside.select("source", "size", "draw", "doc_id", "tie", "rest"), ["source", "size"],
                      ["draw", "doc_id", "tie"], "place")
    last = placed.filter("place + 1 = rest").select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "draw", F.col("doc_id").alias("last_id"),
        F.col("tie").alias("last_tie"))
    return materialize(plan.join(last, key, "left").drop("_s", "_z"), "decisions")


def taken_words(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id, source, size, tie``) and ``source_size, target, taken``."""
    # A row for each source and length: few whatever the corpus, but that is checked.
    few = chosen.count() <= SMALL
    chosen = chosen.select(*[F.col(c).alias(f"_m_{c}") for c in chosen.columns])
    chosen = F.broadcast(chosen) if few else chosen
    key = docs["source"].eqNullSafe(chosen["_m_source"]) & (docs["size"] == chosen["_m_size"])
    draw = _draw(docs["doc_id"])
    first = F.col("_m_more") >= F.col("_m_count")
    id_, last_id = docs["doc_id"], F.col("_m_last_id")
    before = (id_.isNull() & last_id.isNotNull()) | F.coalesce(id_ < last_id, F.lit(False))
    at = id_.eqNullSafe(last_id) & (docs["tie"] <= F.col("_m_last_tie"))
    within = (draw < F.col("_m_draw")) | ((draw == F.col("_m_draw")) & (before | at))
    once = (F.col("_m_more") > 0) & (first | F.coalesce(within, F.lit(False)))
    copies = F.col("_m_repeats") + once.cast("int")
    return docs.join(chosen, key).select(
        *[docs[c] for c in docs.columns], F.col("_m_source_size").alias("source_size"),
        F.col("_m_target").alias("target"), (docs["size"] * copies).cast("long").alias("taken"),
        copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` counts the words of the text (a null has none). A source's target
    is its share by weight of all words, at most ``cap`` sizes. ``taken`` is a
    whole multiple of ``size`` of at most ``cap``; a source's taken words differ
    from its target by less than half a word where its lengths can make the
    sum, else by the nearest that the last stretch finds. A source without
    words, and a document without, takes none. Rows that share an id share a
    draw, and where the border falls among them so many as are needed are
    taken: which of rows of equal id, source and size is open. Null sources are
    one source, null ids one id; other columns are ignored; an empty table
    gives an empty result.
    """
    units = materialize(docs.select("doc_id", "source", *_unit()), "units")
    return taken_words(units, decisions(units, weights, cap)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` as the mix takes them: rows not taken are gone, others stand as often as they are taken.

    A document without words carries no weight and stays once.
    """
    # Stored with the rows, so that a row has the same number where it is drawn and where it is taken.
    inner = materialize(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", *_unit()),
                        "rows")
    counted = taken_words(inner, decisions(inner.drop("row"), weights, cap))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return counted.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op3_mixing": op3_mixing}
SQL: dict[str, str] = {}
