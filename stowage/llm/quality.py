"""A quality classifier by co-training (Blum and Mitchell, 1998).

Two views of a document have a logistic classifier each: its text (shares of
characters, words and lines) and its page metadata (source, language, length).
They start from a bounded sample of labelled documents. In each round each view
labels the unlabelled documents that it is surest of for the other, over the
whole corpus. The views are calibrated on labelled documents that neither was
fitted on, and their calibrated log odds are combined. All documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm import runs
from stowage.llm.tables import documents, draw_share, drawn, enough_of
from stowage.session import materialize

LABELLED = 20_000  # labelled documents that the models are fitted and calibrated on, at most
ROUNDS = 3
EXCHANGED = 500  # pseudo-labels of each kind that a view hands on in a round, at most
SURE = 0.95  # calibrated probability that makes a pseudo-label
GRAIN = 1000  # steps of log odds that are counted to find the surest
HELD_OUT = 0.25  # share of the labelled documents that only calibrate
SOURCES, LANGUAGES = 16, 8  # hashed categories of the metadata
SEED = 5

_CLASSES = ("upper", "lower", "digit", "space", "newline", "sentence", "exclaim", "symbol", "beyond")
_CLASS = np.full(256, 7)
_CLASS[128:] = 8
for _n, _letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c",
                               "\n", ".,;:?'\"()-", "!")):
    _CLASS[[ord(c) for c in _letters]] = _n


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys of each text, and occurrences of its commonest."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))[:len(k)]
    runs_of = np.diff(np.append(first, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs_of)
    return np.bincount(o[first], minlength=n), most


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; a text without words has zeros but for its length."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(n), lengths)
    count = np.bincount(owner * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    share = count / np.maximum(lengths, 1)[:, None]
    starts, ends = runs.words(data, offsets)
    word = owner[starts]
    words = np.bincount(word, minlength=n)
    some = np.maximum(words, 1)
    codes = runs.word_codes(data, starts, ends)
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (word[1:] == word[:-1])
    distinct, most = _distinct(codes, word, n)
    shouted = np.isin(data[np.maximum(ends - 1, 0)], [ord(c) for c in "!#$%&*|~^"]) if len(ends) else np.zeros(0)
    capital = _CLASS[data[starts]] == 0 if len(starts) else np.zeros(0)
    # Lines, by the words and bytes between line ends.
    lines = count[:, 4] + 1
    return np.column_stack([
        np.log1p(words), np.where(words > 0, np.log(np.maximum((lengths - count[:, 3] - count[:, 4]) / some, 1)), 0),
        np.where(words > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)), 1.0), most / some,
        _per_text(same, word, n) / some, share[:, 0] / np.maximum(share[:, 0] + share[:, 1], 1e-9), share[:, 2],
        np.log1p(words / lines), share[:, 5], np.sqrt(share[:, 6]), np.sqrt(share[:, 7]), share[:, 8],
        _per_text(shouted.astype(float), word, n) / some, _per_text(capital.astype(float), word, n) / some,
        (words == 0).astype(float),
    ])


def page_features(source: list, lang: list, n_chars: np.ndarray) -> np.ndarray:
    """One-hot hashed source and language, and the length; a null is a category of its own."""
    n = len(n_chars)
    out = np.zeros((n, SOURCES + LANGUAGES + 3))
    for first, size, values in ((0, SOURCES, source), (SOURCES, LANGUAGES, lang)):
        slot = {v: zlib.crc32(repr(v).encode()) % size for v in set(values)}
        out[np.arange(n), [first + slot[v] for v in values]] = 1
    known = np.isfinite(n_chars) & (n_chars >= 0)
    size = np.log1p(np.where(known, n_chars, 0))
    out[:, -3:] = np.column_stack([size, size ** 2 / 10, ~known])
    return out


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Both views of the rows of a batch, about a megabyte of text at a time."""
    data, offsets = runs.texts(batch, "_text")
    source, lang = batch.column("_source").to_pylist(), batch.column("_lang").to_pylist()
    chars = batch.column("_n_chars").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for a, z in runs.packs(offsets):
        yield a, z, text_features(data[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]), page_features(
            source[a:z], lang[a:z], chars[a:z])


def _inputs(docs: DataFrame) -> list:
    """The columns that the views read; one that the table lacks is null."""
    def given(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(f"_{name}")
    return [given("text", "binary"), given("source", "string"), given("lang", "string"), given("n_chars", "long")]


@dataclass
class Logistic:
    """Logistic regression on standardised features, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean = np.average(x, axis=0, weights=weight)
        scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)), 1e-6)
        z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty),
                                   z.T @ (weight * (p - y)) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class CoTrained:
    """Two calibrated views and their combination."""

    text: Logistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    both: Logistic

    def views(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of good quality, by view."""
        return (self.text_scale.logit(self.text.logit(text)[:, None]),
                self.page_scale.logit(self.page.logit(page)[:, None]))

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by text, by page, and by both."""
        a, b = self.views(text, page)
        return _chance(a), _chance(b), _chance(self.both.logit(np.column_stack([a, b])))


def _fitted(text: tuple, page: tuple, held: tuple) -> CoTrained:
    """Fit each view on its own rows, labels and weights; calibrate and combine on the held-out ones."""
    a, b = Logistic.fit(*text), Logistic.fit(*page)
    x_text, x_page, y, weight = held
    a_scale = Logistic.fit(a.logit(x_text)[:, None], y, weight)
    b_scale = Logistic.fit(b.logit(x_page)[:, None], y, weight)
    both = np.column_stack([a_scale.logit(a.logit(x_text)[:, None]), b_scale.logit(b.logit(x_page)[:, None])])
    return CoTrained(a, b, a_scale, b_scale, Logistic.fit(both, y, weight))


_FEATURES = "doc_id long, text_view array<double>, page_view array<double>"


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and both views of each document."""
    def run(batches):
        for batch in batches:
            for a, z, text, page in _views(batch):
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.array(list(text)), pa.array(list(page))],
                                      names=["doc_id", "text_view", "page_view"])

    return docs.select("doc_id", *_inputs(docs)).mapInArrow(run, _FEATURES)


def _surest(scored: DataFrame, limit: float, n: int) -> dict[str, list]:
    """For each view the ``n`` rows that it is surest of on either side of ``limit``, with their label ``y``.

    Rows are counted by steps of log odds, of which there are some ten thousand
    at most. What lies above the step that holds the n-th row is taken, of that
    step a seeded draw of as many as are missing, so that very many equally
    sure rows are neither sorted nor sent anywhere.
    """
    views = ("by_text", "by_page")
    step = {v: F.floor(F.col(v) * GRAIN) for v in views}
    both = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), step[v].alias("step"), (F.abs(v) >= limit).alias("sure"))
                               for v in views]))
    counts = scored.select(both.alias("s")).filter("s.sure").groupBy("s.view", "s.step").count().collect()
    wanted, any_of = {}, F.lit(False)
    for view in views:
        for sign in (1, -1):
            mine = sorted(((r.step, r["count"]) for r in counts if r.view == view and r.step * sign > 0),
                          key=lambda c: -sign * c[0])
            at, above = 0, 0
            while at < len(mine) and above + mine[at][1] <= n:
                above, at = above + mine[at][1], at + 1
            taken = sign * F.col(view) >= limit
            if at < len(mine):
                border, many = mine[at]
                share = enough_of(n - above, many)
                taken = taken & ((sign * step[view] > sign * border) | (
                    (step[view] == border) & (draw_share(F.lit(SEED), F.col("doc_id")) <= share)))
            wanted[view, sign] = taken
            any_of = any_of | taken
    few = materialize(scored.filter(any_of), "sure")
    return {view: [r for sign in (1, -1) for r in few.filter(wanted[view, sign]).withColumn("y", F.lit(float(sign > 0)))
                   .orderBy(-sign * F.col(view), "doc_id").limit(n).collect()] for view in views}


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.text_view for r in rows]), np.array([r.page_view for r in rows])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS,
          exchanged: int = EXCHANGED) -> CoTrained | None:
    """Co-train both views. None where the labels do not hold both classes often enough (ten each).

    Only rows with an id count here. ``labelled`` bounds the labelled rows that
    come to the driver, half of it for each class, and these weigh as much as
    the class has labels, so chances mean the same with few labels and with
    many; ``exchanged`` bounds the pseudo-labels. Labels of one id are averaged; nulls are no labels.
    """
    views = materialize(features(docs.filter("doc_id is not null")), "views")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = materialize(views.join(marks, "doc_id"), "labelled")
    many = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two classes
    rows = [r for y in (0.0, 1.0) for r in drawn(
        known.filter(F.col("y") == y), labelled // 2, SEED, "doc_id").collect()]
    y = np.array([r.y for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < 10:
        return None
    # The sample may hold the classes in other shares than the labels: its rows weigh as much as those they stand for.
    weight = np.where(y == 0, many[0.0] / (y == 0).sum(), many[1.0] / (y == 1).sum())
    weight /= weight.mean()
    text, page = _arrays(rows)
    held = np.zeros(len(rows), bool)
    for value in (0, 1):
        mine = np.flatnonzero(y == value)
        held[mine[:max(3, int(len(mine) * HELD_OUT))]] = True
    own = (text[~held], y[~held], weight[~held]), (page[~held], y[~held], weight[~held])
    kept = (text[held], page[held], y[held], weight[held])
    model = _fitted(*own, kept)
    pool = materialize(views.join(marks, "doc_id", "left_anti"), "unlabelled")
    limit = float(np.log(SURE / (1 - SURE)))
    for _ in range(rounds):
        def judged(batches, model=model):
            for batch in batches:
                if batch.num_rows:
                    a, b = model.views(*(np.stack(batch.column(c).to_numpy(zero_copy_only=False))
                                         for c in ("text_view", "page_view")))
                    yield pa.record_batch([*batch.columns, pa.array(a), pa.array(b)],
                                          names=[*batch.schema.names, "by_text", "by_page"])

        scored = pool.mapInArrow(judged, _FEATURES + ", by_text double, by_page double")
        given = _surest(scored, limit, exchanged)
        # What one view is sure of, the other learns.
        by_page, by_text = given["by_page"], given["by_text"]
        learnt = []
        for (x, target, weight), new, take in ((own[0], by_page, 0), (own[1], by_text, 1)):
            if new:
                x = np.concatenate([x, _arrays(new)[take]])
                target = np.concatenate([target, [r.y for r in new]])
                weight = np.concatenate([weight, np.ones(len(new))])
            learnt.append((x, target, weight))
        model = _fitted(*learnt, kept)
    return model


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, by_text, by_page, score, keep``.

    Chances of good quality, by view and by both. Null and empty texts are
    judged by what else is known of them. Missing or null metadata is a
    category of its own; repeated rows and null ids are rows like others; other
    columns are ignored; an empty table gives an empty result. Without a model
    everything scores 1 and is kept.
    """
    def run(batches):
        for batch in batches:
            for a, z, text, page in _views(batch):
                n = z - a
                chances = model.score(text, page) if model else (np.ones(n),) * 3
                yield pa.record_batch([batch.column("doc_id").slice(a, n), *map(pa.array, chances),
                                       pa.array(chances[2] >= threshold)],
                                      names=["doc_id", "by_text", "by_page", "score", "keep"])

    schema = "doc_id long, by_text double, by_page double, score double, keep boolean"
    return docs.select("doc_id", *_inputs(docs)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; nothing is shuffled."""
    columns = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        for batch in batches:
            rows = batch.select(names)
            for a, z, text, page in _views(batch):
                good = model.score(text, page)[2] >= threshold if model else np.ones(z - a, bool)
                yield rows.slice(a, z - a).filter(pa.array(good))

    return docs.select(*columns, *_inputs(docs)).mapInArrow(run, schema).toDF(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
