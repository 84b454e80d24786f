"""Importance resampling towards a target distribution of hashed n-grams.

The words of a batch are found at once: its texts are joined by a separator, one
regular expression finds all words of the joined bytes, and a binary search among
the offsets of the texts tells to which text a word belongs. Runs of words that
would reach over a separator are masked before they are counted into buckets.

Counts of the target and of the raw corpus give every bucket an integer gain, the
thousandfold logarithm of the ratio of its smoothed shares. A document weighs the
mean gain of its features; Gumbel noise drawn from a hash of its id turns the
order of the sums into a sample without replacement. Every document is counted
and weighed; the only things that reach the driver are the gains, one number for
each bucket.

Defined results: a null or empty text has no features and weighs 0; a null id is
hashed as an empty one and comes last among equals; rows that repeat are drawn
each by itself, equal rows next to each other; texts of any length are read whole;
an empty corpus gives an empty result, an empty target a smoothed one; other
columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import bounded_batches, scratch_path, settle

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes that are joined at a time; a longer text is joined alone.
SLICE_BYTES = 2_000_000
#: Different n-grams whose buckets a task remembers.
REMEMBERED = 500_000
SEPARATOR = b"\n"
#: Digits, lower-case letters and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


class Features:
    """(document, bucket) of all features of a list of texts, and the words of each text."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.longest, self.known = longest, _Buckets(buckets)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = SEPARATOR.join(texts).translate(LOWER)
        starts, words = [], []
        for m in WORD.finditer(data):
            starts.append(m.start())
            words.append(m.group())
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + len(SEPARATOR)
        offsets = np.cumsum(lengths) - lengths
        doc = np.searchsorted(offsets, np.array(starts, dtype=np.int64), side="right") - 1
        docs, buckets = [], []
        for n in range(1, self.longest + 1):
            whole = len(words) - n + 1
            if whole <= 0:
                break
            runs = words if n == 1 else map(b" ".join, zip(*(words[k: k + whole] for k in range(n)), strict=True))
            inside = doc[:whole] == doc[n - 1:]
            docs.append(doc[:whole][inside])
            buckets.append(np.fromiter(map(self.known.__getitem__, runs), dtype=np.int64, count=whole)[inside])
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(docs or none), np.concatenate(buckets or none), np.bincount(doc, minlength=len(texts))


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in parts of bounded bytes; null is empty."""
    part, size, first = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py()
        part.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): the features of a table of texts by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                total += np.bincount(features(part)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts of both sides."""
    both = (corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
            .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    both = settle(both)
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))

    def share(n: str) -> tuple[Column, Column]:
        total = both.select(F.coalesce(F.sum(n), F.lit(0)).cast("double")).scalar()
        return F.coalesce(n, F.lit(0)).cast("double") + 1, total + buckets

    (t, all_t), (s, all_s) = share("t"), share("s")
    return every.join(both, "bucket", "left").select(
        "bucket", F.floor(1000 * F.log((t * all_s) / (s * all_t))).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        features = Features(len(gain), longest)
        for batch in batches:
            for first, part in slices(batch.column(1)):
                doc, bucket, n_words = features(part)
                n = np.bincount(doc, minlength=len(part))
                total = np.bincount(doc, weights=gain[bucket], minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(total // np.maximum(n, 1), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
             seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` counts the drawn ones.

    Of the documents with ``least_words`` words, floor(``percent`` / 100 of them) are drawn.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, f"importance-{uuid.uuid4().hex[:8]}")
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets).collect():
        gain[row["bucket"]] = row["gain"]
    weighed = weights(docs, gain, doc_id, text, longest).withColumn("score", F.col("weight") + noise(seed))
    weighed.withColumn("able", F.col("n_words") >= least_words).write.parquet(f"{folder}/weights")
    weighed = spark.read.parquet(f"{folder}/weights")
    drawn = weighed.where("able").count() * percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = global_rank(weighed, order, rank="place")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
