"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its line: P(grade <= k) = sigmoid(threshold_k - w.x). A document
gets its expected grade and the probability of reaching the top grade.

Features: distinct lower-cased words without punctuation, and shares of pairs of neighbouring bytes
(they tell symbols and odd spellings that no word repeats). The model is fitted
on a bounded sample of rated documents, drawn by a hash of the id, whose hashed
features the tasks compute; scoring reads every text whole, in one pass without
a shuffle.

Defined results: null and empty texts have no features and get the scores of the
thresholds alone; ratings that are null are not learned from; with no ratings,
or one grade only, every document gets that grade (0 without any) and tail
probability 1; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, WordHasher, mix

WORD_BITS, PAIR_BITS = 18, 12
SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Rated documents that are learned from, at most about this many.
LABELLED_ROWS = 12_000
#: Features of fewer rated documents get no weight.
LEAST_DOCUMENTS = 5
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(texts: list[str | None], hasher: WordHasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, value) of every text."""
    words, bounds = hasher(texts)
    place = (words >> U(64 - WORD_BITS)).astype(np.int64)
    for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if not text:
            yield np.zeros(0, dtype=np.int64), np.zeros(0)
            continue
        own = np.unique(place[a:b])
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(U)
        pairs = (mix((data[:-1] << U(8)) | data[1:]) >> U(64 - PAIR_BITS)).astype(np.int64)
        counts = np.bincount(pairs, minlength=1 << PAIR_BITS)
        at = np.flatnonzero(counts)
        yield (np.concatenate([own, at + (1 << WORD_BITS)]),
               np.concatenate([np.full(len(own), max(len(own), 1) ** -0.5), 3 * np.sqrt(counts[at] / max(len(pairs), 1))]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(lower=True, also=PUNCTUATION)
    for batch in batches:
        found = list(features(batch.column("text").to_pylist(), hasher))
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array([i.astype(np.int32).tolist() for i, _ in found], pa.list_(pa.int32())),
             pa.array([v.astype(np.float32).tolist() for _, v in found], pa.list_(pa.float32()))], names=["grade", "at", "value"])


@dataclass
class Ordinal:
    """Grades in order, weights of the features, thresholds between the grades."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold, a row for each document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def learn(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade",
          rows: int = LABELLED_ROWS, steps: int = 120, penalty: float = 3e-5) -> Ordinal:
    """Fits by full gradients with momentum over the drawn sample.

    ``ratings`` has one row per document (the least grade counts, if several).
    """
    known = ratings.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.min(grade).cast("int").alias("grade"))
    share = min(1.0, rows / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("rated")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(drawn), "doc_id").select("text", "grade").mapInArrow(  # bounded by rows
        _features, "grade int, at array<int>, value array<float>").toArrow()
    y = sample.column("grade").to_numpy()
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return Ordinal(grades or [0], np.zeros(SIZE), np.zeros(0))
    at = sample.column("at").combine_chunks()
    value = sample.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    size = np.diff(at.offsets.to_numpy())
    column, row = at.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), size)
    rank = np.searchsorted(grades, y)
    over = rank[:, None] > np.arange(len(grades) - 1)[None, :]
    w, speed = np.zeros(SIZE), np.zeros(SIZE)
    share_over = over.mean(axis=0).clip(1e-3, 1 - 1e-3)
    t = -np.log(share_over / (1 - share_over))
    # Rare grades count more than their share, but less than alike.
    weight = (1 / np.sqrt(np.bincount(rank, minlength=len(grades))))[rank]
    weight /= weight.sum()
    scale = np.bincount(column, weights=value**2 * weight[row], minlength=SIZE)
    rate = np.where(np.bincount(column, minlength=SIZE) >= LEAST_DOCUMENTS, 1 / (np.sqrt(scale) + 1e-3), 0.0)
    for step in range(steps):
        z = np.bincount(row, weights=value * w[column], minlength=len(y))
        p = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -50, 50)))
        # Likelihood of adjacent cuts: d/dz log(P(>k-1) - P(>k)) = 1 - P(>k-1) - P(>k).
        below = np.where(rank > 0, p[np.arange(len(y)), np.maximum(rank - 1, 0)], 1.0)
        above = np.where(rank < len(grades) - 1, p[np.arange(len(y)), np.minimum(rank, len(grades) - 2)], 0.0)
        slope = (1 - below - above) * weight
        grad = np.bincount(column, weights=value * slope[row], minlength=SIZE) - penalty * w
        speed = 0.9 * speed + rate * grad
        w = w + 2.0 * speed
        gap = np.maximum(below - above, 1e-9)
        pull = np.zeros(len(t))
        np.add.at(pull, np.maximum(rank - 1, 0), np.where(rank > 0, -below * (1 - below) / gap, 0) * weight)
        np.add.at(pull, np.minimum(rank, len(t) - 1), np.where(rank < len(grades) - 1, above * (1 - above) / gap, 0) * weight)
        t = np.maximum.accumulate(t + 2.0 * pull + 1e-6 * np.arange(len(t)))
    return Ordinal(grades, w, t)


def _score(model: Ordinal, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, grades = WordHasher(lower=True, also=PUNCTUATION), np.array(model.grades, dtype=np.float64)
        for batch in batches:
            z = np.array([float(v @ model.weights[i]) for i, v in features(batch.column("text").to_pylist(), hasher)])
            above = model.above(z)
            expected = grades[0] + above @ np.diff(grades) if len(grades) > 1 else np.full(len(z), grades[0])
            k = int(np.searchsorted(grades, top)) - 1
            tail = above[:, k] if 0 <= k < above.shape[1] else np.full(len(z), float(k < 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=["doc_id", "expected_grade", "tail"])
    return run


def score(docs: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text", top: int | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail): tail is the probability of a grade of ``top`` (default: the highest) or more."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score(model, model.grades[-1] if top is None else top), "doc_id long, expected_grade double, tail double")
