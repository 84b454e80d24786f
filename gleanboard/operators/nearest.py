"""Exact vector top-k for one query or a table of queries.

Scoring is a blocked matrix product over Arrow batches. A task keeps k rows
per query, so the pairs are never written out; only the partial winners are
shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import cosine
from ..session import scratch_path, settle
from .bitmaps import MOST_KEYS, bitmap_of, key_hash, may_hold
from .joins import SMALL_ROWS, small_side
from .ranking import top_k, top_k_per_group

TILE = 4_000_000            # scores held at once by a task
QUERY_BLOCK_BYTES = 32 << 20  # bound of what is broadcast
DIGITS = 6   # of the scores that are shown
CUT_DIGITS = 12  # of the scores that decide: equal vectors must tie whatever the order of the sums


def search_one(index: DataFrame, vector: list[float], k: int = 5, digits: int = DIGITS) -> DataFrame:
    """Top-k of one query; ties go to the smaller key.

    The vector is a constant of the plan and the cut is Spark's own top-k.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    score = F.round(cosine(F.col("embedding"), query), CUT_DIGITS)
    hits = index.where(usable()).select("key", score.alias("score"))
    return top_k(hits, best_first(), k).withColumn("score", F.round("score", digits))


def usable(column: str = "embedding") -> Column:
    """True for vectors without null, NaN or infinite items."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("key")]


class _Best:
    """The k best (score, key) of each query seen so far by one task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.kept: list[pd.DataFrame] = []
        self.pending = 0

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        n = len(keys)
        if n == 0:
            return
        step = max(1, TILE // n)
        for lo in range(0, len(self.queries), step):
            scores = self.queries[lo:lo + step] @ vectors.T
            floor = self.floor[lo:lo + step]  # a view: a floor once found holds for all later batches
            new = np.flatnonzero(np.isneginf(floor))
            if n > self.k and len(new):
                floor[new] = np.round(np.partition(scores[new], n - self.k, axis=1)[:, n - self.k], CUT_DIGITS)
            # Only what may reach the floor is rounded; rounding moves a score by less than this.
            reach = floor - (10.0 ** -CUT_DIGITS + 1e-14 * np.abs(np.where(np.isneginf(floor), 0.0, floor)))
            q, c = np.nonzero(scores >= reach[:, None])
            found = np.round(scores[q, c], CUT_DIGITS)
            kept = found >= floor[q]
            q, c, found = q[kept], c[kept], found[kept]
            self.kept.append(pd.DataFrame({"q": q + lo, "score": found, "key": keys[c]}))
            self.pending += len(q)
            if self.pending > TILE:
                self.cut()

    def cut(self) -> pd.DataFrame:
        if not self.kept:
            return pd.DataFrame({"q": [], "score": [], "key": []})
        rows = pd.concat(self.kept, ignore_index=True)
        rows = rows.sort_values(["q", "score", "key"], ascending=[True, False, True])
        place = rows.groupby("q").cumcount()
        rows = rows[place < self.k]
        full = rows[place[place < self.k] == self.k - 1]
        self.floor[full["q"].to_numpy()] = full["score"].to_numpy()
        self.kept, self.pending = [rows], 0
        return rows


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths cannot be compared")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(
    index: DataFrame, queries: DataFrame, k: int = 5, *, digits: int = DIGITS,
    block_bytes: int = QUERY_BLOCK_BYTES, columns: Sequence[str] = (), scope: DataFrame | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """(query_id, rank, key, score) for every query of a table, and ``columns`` of the index.

    ``index`` has key and embedding, ``queries`` query_id and embedding; vectors
    with null, NaN or infinite items are left out. The queries are evaluated once
    and measured, with their ids and their k winners, and cut into blocks of
    ``block_bytes``. Blocks are broadcast, small ones as many as fit ``QUERY_BLOCK_BYTES``
    at a time, and meet the index where it lies, so the index is read once for each
    such round and never moved. A task holds the k best rows of each query of one
    round, whatever the index holds.

    ``scope`` is a table of keys, the only ones that a search may find. It is
    counted: up to ``small_rows`` keys are broadcast; more are sent as a bitmap of
    bounded size, and what it lets through by mistake is taken out of the winners
    and made up for; only beyond ``MOST_KEYS`` are the vectors joined by a shuffle.
    """
    source = index
    index = index.where(usable()).select("key", "embedding")
    queries = settle(queries.where(usable()).select("query_id", "embedding"))
    if scope is None:
        hits = _search(index, queries, k, block_bytes)
    else:
        keys = settle(scope.select("key").distinct())
        n = keys.count()
        if n <= small_rows:
            hits = _search(index.join(F.broadcast(keys), "key", "left_semi"), queries, k, block_bytes)
        elif n <= MOST_KEYS:
            hits = _search_in_bitmap(index, queries, k, block_bytes, keys, n)
        else:
            hits = _search(index.join(keys, "key", "left_semi"), queries, k, block_bytes)
    hits = hits.select("query_id", "rank", "key", F.round("score", digits).alias("score"))
    return with_columns_of(hits, source, columns) if columns else hits


def _search_in_bitmap(index: DataFrame, queries: DataFrame, k: int, block_bytes: int, keys: DataFrame, n: int) -> DataFrame:
    """Hits within many keys. Queries that lost winners to the bitmap are asked for more until none lacks any."""
    bitmap = index.sparkSession.sparkContext.broadcast(bitmap_of(keys, n))
    spare, asked, found = k + max(8, k // 4), queries, []
    while True:
        raw = settle(_search(index, asked, spare, block_bytes, bitmap))
        true = settle(raw.join(keys, "key", "left_semi"))
        got = raw.groupBy("query_id").agg(F.count(F.lit(1)).alias("raw")).join(
            true.groupBy("query_id").agg(F.count(F.lit(1)).alias("true")), "query_id", "left")
        # Complete: k true winners, or there was nothing more to find.
        short = settle(got.where((F.coalesce("true", F.lit(0)) < k) & (F.col("raw") >= spare)).select("query_id"))
        found.append(true.join(short, "query_id", "left_anti").select("query_id", "key", "score"))
        if short.isEmpty():
            break
        asked, spare = settle(asked.join(short, "query_id", "left_semi")), spare * 2
    return top_k_per_group(reduce(DataFrame.unionByName, found), ["query_id"], best_first(), k)


def _search(index: DataFrame, queries: DataFrame, k: int, block_bytes: int, bitmap=None) -> DataFrame:
    """(query_id, key, score, rank) of stored queries, block by block."""
    spark = index.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"),
                       F.sum(F.length(F.col("query_id").cast("string"))).alias("ids")).first()
    total = (size["n"] or 0) * (size["d"] or 0) * 8 + (size["ids"] or 0) + (size["n"] or 0) * k * 24
    schema = StructType([queries.schema["query_id"], index.schema["key"], StructField("score", DoubleType())])
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        partial = _scan(index, queries, k, schema, bitmap)
    else:
        folder = scratch_path(spark, "hits")
        # Positions in a checkpoint do not change, so a query is in one block.
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
        queries.withColumn("_block", place).repartition("_block").write.partitionBy("_block").parquet(f"{folder}/queries")
        dealt = spark.read.schema(StructType([*queries.schema, StructField("_block", IntegerType())])).parquet(f"{folder}/queries")
        together = max(1, QUERY_BLOCK_BYTES // block_bytes)
        for i in range(0, blocks, together):
            block = dealt.where(F.col("_block").between(i, i + together - 1)).select("query_id", "embedding")
            _scan(index, block, k, schema, bitmap).write.mode("append").parquet(f"{folder}/partial")
        partial = spark.read.schema(schema).parquet(f"{folder}/partial")
    # A query has k rows of each task at most: no group to cut in parts first.
    return top_k_per_group(partial, ["query_id"], best_first(), k, spread=1)


def with_columns_of(hits: DataFrame, index: DataFrame, columns: Sequence[str] = ("metadata",)) -> DataFrame:
    """The hits with columns of their index rows. Only those columns are read
    again; the hits are stored, counted and broadcast while they are few."""
    hits = settle(hits)
    carried = index.select("key", *columns).join(small_side(hits.select("key").distinct()), "key", "left_semi")
    return hits.join(carried, "key", "left").select("query_id", "rank", "key", "score", *columns)


def _scan(index: DataFrame, queries: DataFrame, k: int, schema: StructType, bitmap=None) -> DataFrame:
    """The k best rows of every query that each task has seen; with a (broadcast) bitmap, of the keys it may hold."""
    table = queries.toArrow()
    id_type, key_type = (to_arrow_type(schema[c].dataType) for c in ("query_id", "key"))
    shared = index.sparkSession.sparkContext.broadcast(
        (table.column("query_id").to_pylist(), _matrix(table.column("embedding"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = _Best(matrix, k)
        for batch in batches:
            if bitmap is not None and batch.num_rows:
                batch = batch.filter(pa.array(may_hold(bitmap.value, batch.column(2).to_numpy())))
            if matrix.size and batch.num_rows:
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                best.add(keys, _matrix(batch.column(1)))
        rows = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in rows["q"].astype(np.int64)], id_type), pa.array(list(rows["key"]), key_type),
             pa.array(rows["score"].to_numpy(np.float64), pa.float64())],
            names=["query_id", "key", "score"])

    if bitmap is not None:
        index = index.select("key", "embedding", key_hash().alias("_h"))
    return index.mapInArrow(run, schema)
