"""Embedding: a table of texts to an accumulating table of unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.keys import metadata
from ..functions.text import retrieval_text
from ..operators.dedupe import require_unique_key
from ..operators.joins import key_intersection, small_side, without_keys
from ..operators.passes import call_each
from ..session import bounded_batches, settle

# An embedder takes the texts of a batch and returns one vector per text.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 256


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Deterministic stand-in: signed token hashing. Empty text gives zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1.0 if (h >> 40) & 1 else -1.0
        return out.tolist()

    return embed


def _unit(vector: list[float] | None) -> np.ndarray | None:
    if vector is None:
        return None
    v = np.asarray(vector, dtype=np.float64)
    n = np.sqrt((v * v).sum())
    return (v if n == 0 else v / n).astype(np.float32)


def with_embedding(df: DataFrame, text: str, embedder: Embedder, batch: int = BATCH,
                   column: str = "embedding") -> DataFrame:
    """Add the unit vector of a text column. A failing batch is sent text by
    text; a failing text gives null and costs nobody else anything.

    Rows reach Python in Arrow batches of bounded bytes; only the texts of one
    ``batch`` become Python objects at a time, other columns pass as they are."""
    bounded_batches(df.sparkSession)
    schema = T.StructType(list(df.schema)).add(column, T.ArrayType(T.FloatType()))
    at_text, kind = df.columns.index(text), pa.list_(pa.float32())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            vectors: list[np.ndarray | None] = []
            for at in range(0, frame.num_rows, batch):
                vectors += [_unit(v) for v, _ in call_each(embedder, frame.column(at_text).slice(at, batch).to_pylist())]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(vectors, kind)], names=[*frame.schema.names, column])

    return df.mapInArrow(run, schema)


def documents(postings: DataFrame) -> DataFrame:
    """key, retrieval text and filterable metadata of the postings."""
    text = retrieval_text(*[F.col(c) for c in ("title", "employer_name", "city", "description")])
    return postings.select(F.col("key").cast("string").alias("key"), text.alias("document"),
                           metadata(postings.columns).alias("metadata"))


def to_embed(postings: DataFrame, index: DataFrame) -> DataFrame:
    """Postings whose key is not in the index yet."""
    return without_keys(postings, index.select("key"))


def embed_new(postings: DataFrame, index: DataFrame, embedder: Embedder, model: str,
              batch: int = BATCH) -> DataFrame:
    """Rows to append to the index; null vectors mark what could not be embedded."""
    # A key that repeats is embedded once: the smallest text, whatever the order of the rows.
    fresh = documents(to_embed(postings, index)).groupBy("key").agg(F.min_by(F.struct("document", "metadata"), "document").alias("d")).select("key", "d.*")
    return with_embedding(fresh, "document", embedder, batch).withColumn("model", F.lit(model))


def build_index(
    postings: DataFrame, path: str, embedder: Embedder, model: str, batch: int = BATCH, *, build: str | None = None,
    unique_keys: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extend the stored index and return (index, scope, dropped keys).

    Only new keys are embedded, each once. ``scope`` is what a search for the
    caller's table may see, although the stored table holds more. A build under a
    name can be repeated: it replaces what its first attempt stored.
    ``unique_keys`` refuses a table in which a key repeats.
    """
    from ..operators.summary import dropped_rows
    from ..sources.tables import append_embeddings, read_embeddings

    spark = postings.sparkSession
    if unique_keys:
        require_unique_key(postings)
    stored = read_embeddings(spark, path, model, parts=True).where(~F.col("build").eqNullSafe(F.lit(build or "")))
    fresh = settle(embed_new(postings, stored, embedder, model, batch))
    append_embeddings(fresh.where(F.col("embedding").isNotNull()), path, build)
    index = read_embeddings(spark, path, model)
    scope = key_intersection(postings, index)
    if scope.isEmpty() and not postings.isEmpty():
        raise RuntimeError("the index scope is empty: no row of the table could be embedded")
    return index, scope, dropped_rows(fresh)


def scoped(index: DataFrame, postings: DataFrame) -> DataFrame:
    """The part of the index the caller's table covers. ``search(scope=...)`` needs no such table."""
    return index.join(small_side(settle(postings.select("key").distinct())), "key", "left_semi")
