"""Severity of toxic language by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.slices import filter_slices, map_slices
from basketmatch.llm.wordhash import LETTERS, word_hashes

#: Labelled documents that a model is fitted on, at most; they are picked by hash.
MAX_LABELLED = 4_000
#: A feature is a word of so many labelled texts at least, whose toxic share surely
#: (lower Wilson bound at so many deviations) is this many times the toxic share of
#: all; the surest are taken. Rarer words and equal texts would only learn noise.
MIN_DOCUMENTS, DEVIATIONS, TIMES_BASE, MAX_FEATURES = 8, 3.0, 2.0, 2_000
#: Besides whole words, their beginnings of so many bytes are features, for stems.
PREFIXES = (4, 5, 6, 7)
#: Expected severity from which a document counts as toxic.
REJECT = 0.5
STEPS, RATE, RIDGE = 1_500, 0.1, 1e-5


@dataclass
class Model:
    """Hashes of the feature words (sorted), their weights, and ordered thresholds."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(2, 50.0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(grade <= k) = sigmoid(threshold_k - w x).

    One weight vector serves all thresholds. The thresholds stay ordered as sums of
    positive steps. Adam on the whole sample with a small ridge.
    """
    n, k = len(grades), int(grades.max())
    share = np.clip([(grades <= j).mean() for j in range(k)], 0.01, 0.99)
    start = np.log(share / (1 - np.asarray(share)))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, STEPS + 1):
        w, steps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = np.concatenate([[-np.inf], p[n_features] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        score = np.bincount(rows, values * w[cols], n)
        hi, lo = _sigmoid(theta[grades + 1] - score), _sigmoid(theta[grades] - score)
        like = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        by_theta = [(np.sum(d_lo[grades == j + 1]) - np.sum(d_hi[grades == j])) / n for j in range(k)]
        g = np.concatenate([
            np.bincount(cols, values * (d_hi - d_lo)[rows], n_features) / n + RIDGE * w,
            [np.sum(by_theta)],
            [np.sum(by_theta[j:]) * steps[j - 1] for j in range(1, k)],
        ])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def expected_severity(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Sum over the thresholds of the probability to lie beyond."""
    return (1 - _sigmoid(thresholds[None, :] - score[:, None])).sum(1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, words, at in word_hashes(batch["text"].tolist(), LETTERS, PREFIXES):
            counted = [np.unique(words[s:e][words[s:e] > 0], return_counts=True) for s, e in zip(at[:-1], at[1:])]
            yield pd.DataFrame({
                "toxic": batch["toxic"].iloc[first : first + len(counted)].to_numpy(),
                "n_words": np.diff(at),
                "words": [w.view(np.int64) for w, _ in counted],
                "times": [c.astype(np.int32) for _, c in counted],
            })


def _sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Word counts of up to MAX_LABELLED documents; labelled twice, the higher label counts."""
    labels = labels.where("doc_id is not null and toxic is not null")
    labels = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    keep = min(1.0, 1.25 * MAX_LABELLED / max(1, labels.count()))
    picked = labels.where(draw < int(keep * (1 << 30))).orderBy(draw, "_id").limit(MAX_LABELLED)
    # The sample's ids and labels are bounded by MAX_LABELLED.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.expr("doc_id = _id")).select("text", "toxic")
    return map_slices(texts, _count, "toxic int, n_words long, words array<long>, times array<int>").toArrow().to_pandas()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on documents labelled 0 or 1 (``labels``: doc_id, toxic).

    The words and beginnings of words whose presence goes with the label become
    features, weighted by log(1 + occurrences per thousand words). Toxic documents get grade 2 if these
    words are at least as dense in them as in the median toxic document that has
    any, else 1; others grade 0. Without both labels, or without such words, the
    model gives severity 0 to everything.
    """
    sample = _sample(docs, labels)
    sample = sample[~sample["words"].map(lambda w: w.tobytes()).duplicated()].reset_index(drop=True)
    toxic = sample["toxic"].to_numpy(np.int64) > 0
    if len(sample) == 0 or toxic.all() or not toxic.any():
        return Model()
    sizes = sample["words"].map(len).to_numpy()
    row = np.repeat(np.arange(len(sample)), sizes)
    word = np.concatenate(sample["words"].to_numpy()).astype(np.int64).view(np.uint64)
    times = np.concatenate(sample["times"].to_numpy()).astype(float)
    vocabulary, col = np.unique(word, return_inverse=True)
    with_word = np.bincount(col)
    both = np.bincount(col, toxic[row])
    n, t = len(sample), toxic.sum()
    share, z = both / with_word, DEVIATIONS**2 / with_word
    spread = np.sqrt(z * share * (1 - share) + z * z / 4)
    surely = (share + z / 2 - spread) / (1 + z)
    good = np.flatnonzero((with_word >= MIN_DOCUMENTS) & (surely >= min(TIMES_BASE * t / n, 0.5)))
    good = np.sort(good[np.argsort(-surely[good], kind="stable")[:MAX_FEATURES]])
    if not len(good):
        return Model()
    number = np.full(len(vocabulary), -1)
    number[good] = np.arange(len(good))
    total = np.maximum(sample["n_words"].to_numpy(), 1)
    kept = number[col] >= 0
    row, col, rate = row[kept], number[col[kept]], 1000 * times[kept] / total[row[kept]]
    dense = np.bincount(row, rate, n)
    some = dense[toxic & (dense > 0)]
    grades = np.where(toxic, 1 + (dense >= np.median(some)), 0) if len(some) else toxic.astype(int)
    weights, thresholds = fit_ordinal(row, col, np.log1p(rate), grades.astype(np.int64), len(good))
    return Model(vocabulary[good], weights, thresholds)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, severity (expected grade, 0 to 2), toxic.

    A null or empty text, and one without words, has severity 0. Extra columns are
    ignored; repeated rows are scored alike.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, words, at in word_hashes(batch["text"].tolist(), LETTERS, PREFIXES):
                grade = _severity(model, words, at)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[first : first + len(grade)].to_numpy(),
                    "n_words": np.diff(at), "severity": grade, "toxic": grade >= REJECT,
                })

    return map_slices(docs.select("doc_id", "text"), score, "doc_id long, n_words long, severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is toxic; scored row by row, without a shuffle."""

    def keep(texts: list[str | None]) -> list[bool]:
        clean = np.ones(len(texts), bool)
        for first, words, at in word_hashes(texts, LETTERS, PREFIXES):
            clean[first : first + len(at) - 1] = _severity(model, words, at) < REJECT
        return clean.tolist()

    return filter_slices(docs, "text", keep)


def _severity(model: Model, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected severity of the texts of a group."""
    v, n, length = model.vocabulary, len(at) - 1, np.diff(at)
    points = np.zeros(n)
    if len(v) and len(words):
        flat = words.ravel()
        place = np.minimum(np.searchsorted(v, flat), len(v) - 1)
        hit = np.flatnonzero(v[place] == flat)
        doc = np.searchsorted(at, hit // words.shape[1], side="right") - 1
        pair, times = np.unique(doc * len(v) + place[hit], return_counts=True)
        doc = pair // len(v)
        points = np.bincount(doc, model.weights[pair % len(v)] * np.log1p(1000 * times / length[doc]), n)
    return np.where(length > 0, expected_severity(points, model.thresholds), 0.0)
