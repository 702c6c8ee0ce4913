"""Toxicity by a classifier chain.

Three categories are predicted one after the other, each by a logistic
regression over term features and the probabilities of the categories before
it: ``abusive`` (labelled toxic, with terms that are typical of toxic texts),
``severe`` (abusive, with at least the median share of such terms) and
``toxic`` (the label itself). While the chain is fitted, the earlier
probabilities are out-of-fold predictions, so that a later model learns from
probabilities as good as those it will get, not from fitted ones.

Scale: the chain is fitted on at most ``sample_rows`` labelled documents, chosen
by a hash of their id, and at most ``terms`` terms; only counts of these terms
reach the driver. Documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import documents_of, stored, strings, unused

CATEGORIES = ["abusive", "severe", "toxic"]
SAMPLE_ROWS = 4000
TERMS = 320
FOLDS = 5
THRESHOLD = 0.5
#: A term is typical of toxic texts if it is so many times as frequent there.
TYPICAL = 8.0
#: Words a worker remembers the terms of, at most.
MEMO = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """A word itself and its beginnings of 4 to 7 letters."""
    return [word] + [f"{word[:k]}-" for k in range(4, 8) if len(word) > k]


@dataclass
class Chain:
    """Fitted weights: one row per category over terms, earlier probabilities and a constant."""

    terms: dict[str, int]
    weights: list[np.ndarray]

    def features(self, counts: Counter, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Square roots of the terms' shares of all words, times ten."""
        x = np.zeros(len(self.terms))
        for word, n in counts.items():
            found = memo.get(word)
            if found is None:
                found = memo[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            for i in found:
                x[i] += n
        return 10.0 * np.sqrt(x / max(1, sum(counts.values())))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column per category; later ones see earlier ones."""
        out: list[np.ndarray] = []
        for w in self.weights:
            out.append(_sigmoid(_design(x, out) @ w))
        return np.column_stack(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _design(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([x, *earlier, np.ones(len(x))])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights by Adam on all rows; the last column of x is the constant and is not decayed."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    shrink = np.full(x.shape[1], decay, dtype=np.float32)
    shrink[-1] = 0.0
    for t in range(1, steps + 1):
        g = x.T @ (_sigmoid(x @ w) - y) / max(1, len(y)) + shrink * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit_chain(x: np.ndarray, labels: list[np.ndarray], folds: np.ndarray) -> list[np.ndarray]:
    """Weights of each category; earlier categories enter with out-of-fold probabilities."""
    earlier: list[np.ndarray] = []
    weights = []
    for y in labels:
        design = _design(x, earlier)
        weights.append(fit_logistic(design, y))
        out = np.zeros(len(y))
        for k in np.unique(folds):
            held = folds == k
            out[held] = _sigmoid(design[held] @ fit_logistic(design[~held], y[~held])) if (~held).any() else y[held].mean()
        earlier.append(out)
    return weights


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS) -> Chain:
    """Fit the chain on labelled documents. Labels that are null, or of unknown documents, do not count.

    Without any labelled document the chain calls nothing toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_l"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and _l is not null")
    chosen = known.orderBy(F.xxhash64("_l"), "_l", "toxic").limit(sample_rows)
    plain = documents_of(docs)
    # a labelled id may stand in many rows: the bound holds for what was found, too
    found = plain.join(chosen, plain.doc_id == chosen._l).select("doc_id", "toxic", "text")
    sample = stored(found.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("text")).limit(sample_rows), "labelled-sample")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
                seen[min(1, max(0, toxic))].update({t for w in word_counts(text.decode()) for t in terms_of(w)})
        names = list(seen[0] | seen[1])
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[t] for t in part], pa.int64()) for c in seen]], names=["term", "clean", "toxic"])

    sizes = {r.toxic: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Chain({}, [np.full(1 + i, 0.0) - 30.0 * (np.arange(1 + i) == i) for i in range(len(CATEGORIES))])
    counted = sample.mapInArrow(presence, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gap = F.col("toxic") / n1 - F.col("clean") / n0
    best = counted.where("clean + toxic >= 3").withColumn("gain", F.abs(gap) / F.sqrt((F.col("clean") + F.col("toxic")) / (n0 + n1)))
    picked = best.orderBy(F.desc("gain"), "term").limit(terms).collect()
    chain = Chain({r.term: i for i, r in enumerate(picked)}, [])
    typical = np.array([((r.toxic + 0.5) / n1) / ((r.clean + 0.5) / n0) >= TYPICAL for r in picked])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            x = [chain.features(word_counts(t.decode()), memo) for t in strings(batch.column(2))]
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tolist() for i in at], pa.list_(pa.int64())),
                                              pa.array([v[i].tolist() for v, i in zip(x, at, strict=True)], pa.list_(pa.float64()))], names=["doc_id", "toxic", "at", "x"])

    rows = sample.mapInArrow(vectors, "doc_id long, toxic int, at array<long>, x array<double>").orderBy("doc_id").collect()
    x = np.zeros((len(rows), len(picked)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["x"]
    toxic = np.array([float(r.toxic > 0) for r in rows])
    share = (x[:, typical] ** 2).sum(axis=1)
    abusive = toxic * (share > 0)
    severe = abusive * (share >= (np.median(share[abusive > 0]) if abusive.any() else 0))
    folds = np.array([int(r.doc_id * 2654435761 % (1 << 32)) * FOLDS >> 32 for r in rows])
    chain.weights = fit_chain(x, [abusive, severe, toxic], folds)
    return chain


def probabilities(text: Column, chain: Chain) -> Column:
    """A struct of the categories' probabilities for a text column."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            if len(memo) > MEMO:
                memo.clear()
            x = np.array([chain.features(word_counts(t or ""), memo) for t in texts]).reshape(len(texts), len(chain.terms))
            yield pd.DataFrame(chain.predict(x), columns=CATEGORIES)

    of = F.pandas_udf(score, ", ".join(f"{c} double" for c in CATEGORIES))
    return of(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, p_abusive, p_severe, p_toxic, rejected``, one row per row of ``docs``.

    The chain is fitted on ``labelled`` documents with ``labels``. Null and empty texts
    get the probabilities of a text without known terms. Repeated rows and rows
    without doc_id are scored each by its own text.
    """
    p = documents_of(docs).select("doc_id", probabilities(F.col("text"), train(labelled, labels, sample_rows)).alias("p"))
    return p.select("doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES], (F.col("p.toxic") >= threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with their columns as they are."""
    chain = train(labelled, labels)
    p = unused(docs, "_p_row")
    return docs.withColumn(p, probabilities(F.col("text"), chain)).where(F.col(p)["toxic"] < threshold).select(*docs.columns)
