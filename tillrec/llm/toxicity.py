"""Toxicity by a classifier chain.

Categories are predicted one after another: each has a linear model over the document's words, and
every later model also gets the probabilities of the earlier categories. For training these are
out-of-fold: the earlier category's model for a fold has not seen its documents, so later models
learn from probabilities as good as those they will get. The labels table has two categories, so
the chain is low quality, then toxic; the operator takes any list of 0/1 label columns.

A document's features are its distinct words (as in decontamination) and their beginnings of three to
eight letters (inflected forms share them), hashed to 2^18 places, each counted once. Models are logistic with an L1 penalty (follow-the-regularised-leader), so words that
say nothing get weight zero, and long documents aren't carried away by many small weights. The
threshold of a category is the one of best F1 on the out-of-fold probabilities.

Fitting uses at most ``MAX_ROWS`` labelled documents (those whose doc_id hashes least), a documented
bound; only their word places reach the driver. Scoring is per row on all whole texts, without a
shuffle; the model that is broadcast has a fixed size.

Defined cases: null text has no words (the intercept decides); labels of a repeated doc_id join by
their maximum, null labels are left out; null or repeated doc_ids give one row per input row; a category
without both classes in the sample gets its class rate as a constant and is never flagged; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common
from tillrec.llm.decontaminate import words

MAX_ROWS = 6000
PLACES = 1 << 18
PREFIXES = (3, 8)               # lengths of the word beginnings that are features too
CACHED_WORDS = 200_000          # words whose places a worker keeps
FOLDS = 3
EPOCHS = 4
# settings of the linear models
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 1.0


class _WordPlaces(dict):
    """Feature places of a word: the word itself and its beginnings; a bounded cache."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        text = word.decode()
        keys = [text, *(f"{text[:k]}~" for k in range(PREFIXES[0], min(PREFIXES[1], len(text) - 1) + 1))]
        found = tuple(xxhash.xxh3_64_intdigest(k) & (PLACES - 1) for k in keys)
        if len(word) <= 40:
            self[word] = found
        return found


_word_places = _WordPlaces()


def places(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature places of a text."""
    found = {p for w in set(words(text)) for p in _word_places[w]}
    return np.array(sorted(found), dtype=np.int32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Linear:
    """A logistic model: weights of the words, of the earlier probabilities, and the intercept."""
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray, before: list[float]) -> float:
        z = self.intercept + float(self.weights[x].sum())
        return float(sigmoid(z + float(np.dot(self.earlier, before)) if before else z))


def fit(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    """One model over word places and the earlier probabilities (one row each)."""
    n_before = before.shape[1]
    size = PLACES + n_before + 1
    if not len(y) or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        return Linear(np.zeros(PLACES), np.zeros(n_before), float(np.log(rate / (1 - rate))))
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    penalty = np.full(size, L1)
    penalty[PLACES:] = 0.0                                # neither chain inputs nor the intercept
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at = np.concatenate([rows[i], np.arange(PLACES, size, dtype=np.int32)])
            value = np.ones(len(at))
            value[len(rows[i]):-1] = before[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= penalty[at], 0.0,
                          -(zi - np.sign(zi) * penalty[at]) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (sigmoid(np.dot(wi, value)) - y[i]) * value
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Linear(w[:PLACES], w[PLACES:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the best F1, in the middle of the gap below it; above 1 if a class is missing."""
    if not len(y) or y.min() == y.max():
        return 2.0
    order = np.argsort(-p, kind="stable")
    ps, ys = p[order], y[order]
    hits = np.cumsum(ys)
    f1 = 2 * hits / (np.arange(1, len(ys) + 1) + ys.sum())
    last_of_tie = np.append(ps[:-1] != ps[1:], True)
    k = int(np.argmax(np.where(last_of_tie, f1, -1.0)))
    return float((ps[k] + (ps[k + 1] if k + 1 < len(ps) else 0.0)) / 2)


@dataclass
class Chain:
    """Models and thresholds in the order of the categories."""
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, x: np.ndarray) -> list[float]:
        out: list[float] = []
        for m in self.models:
            out.append(m.probability(x, out))
        return out


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Fit the chain; ``labels`` has one 0/1 column per category. Fold of a row: its number mod FOLDS."""
    fold = np.arange(len(rows)) % FOLDS
    before = np.zeros((len(rows), 0))
    models, thresholds = [], []
    for c in range(len(categories)):
        y = labels[:, c].astype(float)
        held = np.zeros(len(rows))
        for k in range(FOLDS):
            train = np.flatnonzero(fold != k)
            m = fit([rows[i] for i in train], before[train], y[train])
            for i in np.flatnonzero(fold == k):
                held[i] = m.probability(rows[i], list(before[i]))
        models.append(fit(rows, before, y))
        thresholds.append(best_threshold(held, y))
        before = np.column_stack([before, held])
    return Chain(categories, models, thresholds)


def labelled_places(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
                    max_rows: int = MAX_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Word places and labels of the bounded sample."""
    names = list(categories)
    marked = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]).na.drop()
    # at most max_rows rows: small enough to broadcast by that bound
    sample = marked.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places(t) for t in common.utf8_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "places"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = chosen.mapInArrow(run, "doc_id long, places array<int>").groupBy("doc_id").agg(F.min("places").alias("places"))
    rows = sorted(found.join(F.broadcast(sample), "doc_id").collect(), key=lambda r: r["doc_id"])
    return ([np.array(r["places"], dtype=np.int32) for r in rows],
            np.array([[r[n] for n in names] for r in rows], dtype=np.int8).reshape(len(rows), len(names)))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, then for every category its probability and whether it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{c}", pa.float64()) for c in chain.categories],
                        *[(c, pa.bool_()) for c in chain.categories]])
    ddl = ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.categories],
                     *[f"{c} boolean" for c in chain.categories]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = [model.probabilities(places(t)) for t in common.utf8_column(batch, "text")]
            by_category = list(zip(*p)) if p else [()] * len(model.categories)
            cols = [pa.array(c, pa.float64()) for c in by_category]
            cols += [pa.array([x >= t for x in c], pa.bool_()) for c, t in zip(by_category, model.thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def label_categories() -> dict[str, Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    categories = label_categories()
    rows, labels = labelled_places(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), categories)
    return scored(docs, fit_chain(rows, labels, tuple(categories)))
