"""Language identification by multilingual mixture inference.

Every language has a table of log-likelihoods of hashed character n-grams,
counted by Spark from labelled documents. A document is a mixture: each of its
words comes from one of its languages, and expectation-maximisation estimates
the proportions from the words' n-gram likelihoods. Sets of one, two and more
languages (the most probable ones) are compared by likelihood less a penalty
for each further language; a set grows until a further language is not worth its
penalty. The chosen set comes with its proportions, the largest of them is the answer.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and
when nothing could be learned; whole texts of any length are read; equal
proportions go to the smaller language name; rows that repeat are each answered;
rows with a null language or id are not learned from; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches
from .words import SPACE_BYTES, U, mix

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Labelled documents per language that are learned from, about (drawn by a hash of the id).
LABELLED_ROWS = 3000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
STEPS = 12


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its word, first word of every text) over the bytes of lower-cased texts.

    An n-gram lies inside a word with the white space before and after it.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" " + b"  ".join(parts) + b" ", dtype=np.uint8).copy()
    space = np.isin(data, np.frombuffer(SPACE_BYTES, dtype=np.uint8))
    data[space] = 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    word = np.cumsum(np.concatenate([[False], space[:-1] & ~space[1:]])) - 1
    wide = data.astype(U)
    buckets, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, U(n))
        inner = np.zeros(len(code), dtype=bool)  # a space in the middle, or nothing but spaces
        for k in range(n):
            code = (code << U(8)) | wide[k: k + len(code)]
            if 0 < k < n - 1:
                inner |= space[k: k + len(code)]
        last = space[n - 1:]
        ok = ~inner & ~(space[: len(code)] & last)
        at = np.flatnonzero(ok)
        buckets.append((mix(code[at]) >> U(49)).astype(np.int64))
        owners.append(np.where(space[at], word[np.minimum(at + 1, len(word) - 1)], word[at]))
    bounds = np.cumsum([0] + [len(p) + 2 for p in parts])[:-1] + 1
    firsts = np.searchsorted(start, bounds)
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), firsts
    return np.concatenate(buckets), np.concatenate(owners), np.append(firsts, len(start))


def _slices(texts: list, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _count(names: list[str]):
    """Per task one row (language, counts of all buckets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(names), BUCKETS), dtype=np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for k, name in enumerate(names):
                own = [t for t, g in zip(texts, langs, strict=True) if g == name and t]
                for a, b in _slices(own):
                    table[k] += np.bincount(_grams(own[a:b])[0], minlength=BUCKETS)
        lang, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[lang, bucket])], names=["lang", "bucket", "n"])
    return run


class Model:
    """Log-likelihoods of n-grams by language: a fixed table of languages x BUCKETS."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = LABELLED_ROWS) -> Model:
    """Counts n-grams of labelled documents, about ``rows`` of each language."""
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "doc_id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.lit(1.0)
    for name in names:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, rows / sizes[name]))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < share * 1_000_000)
    summed = drawn.mapInArrow(_count(names), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), BUCKETS))
    for r in summed.toLocalIterator():  # at most languages x BUCKETS rows
        counts[r["lang"], r["bucket"]] = r["n"]
    return Model(names, counts)


def infer(model: Model, texts: list[str]) -> np.ndarray:
    """Proportions [text, language] of the chosen set of each text that has words; 0 outside the set."""
    bucket, word, firsts = _grams(texts)
    n_words, k = int(firsts[-1]), len(model.names)
    like = np.zeros((n_words, k))
    order = np.argsort(word, kind="stable")
    bucket, word = bucket[order], word[order]
    edges = np.searchsorted(word, np.arange(n_words + 1))
    full = edges[1:] > edges[:-1]
    if full.any():
        like[full] = np.add.reduceat(model.logs[bucket].astype(np.float64), edges[:-1][full], axis=0)
    top = like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(like - top, -60.0))
    sizes = np.diff(firsts)

    def fit(rows, share, steps=STEPS):
        """Proportions and log-likelihood of some texts after so many steps."""
        mine = like if len(rows) == len(sizes) else like[np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)]
        begin = np.cumsum(sizes[rows]) - sizes[rows]
        doc = np.repeat(np.arange(len(rows)), sizes[rows])
        for _ in range(steps):
            part = mine * share[doc]
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, begin, axis=0) / sizes[rows, None]
        return share, np.add.reduceat(np.log((mine * share[doc]).sum(axis=1) + 1e-300), begin)

    every = np.arange(len(sizes))
    all_of_them, _ = fit(every, np.full((len(sizes), k), 1.0 / k))
    rank = np.argsort(np.argsort(-all_of_them, axis=1, kind="stable"), axis=1)
    best, chosen = np.full(len(sizes), -np.inf), np.zeros((len(sizes), k))
    growing = every  # texts whose last language was worth its penalty
    for m in range(1, k + 1):
        start = np.where(rank[growing] < m, np.maximum(all_of_them[growing], 1e-3), 0.0)
        start /= start.sum(axis=1, keepdims=True)
        share, fit_of = fit(growing, start, STEPS if m > 1 else 0)
        worth = fit_of - (m - 1) * (0.5 * np.log(sizes[growing] + 1.0) + np.log(k))
        better = worth > best[growing]
        growing, share, worth = growing[better], share[better], worth[better]
        best[growing], chosen[growing] = worth, share
        if not len(growing):
            break
    return chosen


def _predict(model: Model, text: str, more: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sets: list[list[str]] = [[] for _ in texts]
            shares: list[list[float]] = [[] for _ in texts]
            for a, b in _slices(texts):
                have = [i for i in range(a, b) if texts[i] and model.names and LETTER.search(texts[i])]
                if have:
                    for i, share in zip(have, infer(model, [texts[i] for i in have]), strict=True):
                        order = np.argsort(-share, kind="stable")[: np.count_nonzero(share)]
                        sets[i] = [model.names[c] for c in order.tolist()]
                        shares[i] = np.clip(share[order], 0.0, 1.0).tolist()
            first = [s[0] if s else UNKNOWN for s in sets]
            score = [s[0] if s else 0.0 for s in shares]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())),
                 pa.array(shares, pa.list_(pa.float64()))], names=[*batch.schema.names, *more])
    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            into: tuple[str, str, str, str] = ("lang_pred", "score", "languages", "proportions")) -> DataFrame:
    """The columns of ``keep`` with the largest language and its proportion, and the chosen set, largest first.

    Only the text decides. ``into`` names the new columns; a text that is kept travels once.
    """
    bounded_batches(docs.sparkSession)
    names = {c: f"_k{i}" for i, c in enumerate(dict.fromkeys((*keep, text)))}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    more = ["_lang", "_score", "_languages", "_proportions"]
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), "_lang string", "_score double", "_languages array<string>", "_proportions array<double>"])
    out = rows.mapInArrow(_predict(model, names[text], more), schema)
    return out.select(*(F.col(names[c]).alias(c) for c in keep), *(F.col(a).alias(b) for a, b in zip(more, into, strict=True)))
