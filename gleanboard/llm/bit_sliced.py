"""Exact top-k inner products from a bit-sliced index.

Every component becomes the integer floor(scale * x). The index holds blocks of
rows; a block keeps, for each dimension, the most significant bits of its
integers as slices: one bitmap over the rows for each bit. For a query the slices
are added with bitmap arithmetic: dimensions that share a bit of the query's
weight are summed by a tree of ripple adders, and the sums are doubled and added
from the highest bit of the weights down. A negative weight reads the complement
of its slices, so every addend is positive. The rows of the k greatest sums are
then picked from the most significant slice downward. The bits left out of the
slices bound how far a sum can be off, so all rows that this bound allows to be
among the best are boundary rows, and their exact integer products decide.

The index is written once. Queries are dealt into batches of bounded bytes; a
batch is broadcast and the index is read, not moved. A task keeps k rows for each
query of a batch, and only those are shuffled.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part; only vectors of equal length are compared (empty ones have score
0); ties go to the smaller id, null ids last; rows with the query's own id are no
candidates, so copies of a row under one id are not found for each other, and
each row of a repeated query id gives a list of its own; a row with a null id is
a candidate but no query; scores beyond 64 bits stand at the ends of that range;
fewer than k candidates give a shorter list; an empty table gives an empty
result; other columns are not read. Vectors may have any length.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SCALE = 1024
#: Rows of a block, a multiple of 64.
BLOCK = 4096
#: Most significant bits of a dimension that are kept as slices.
SLICES = 7
#: Bound of the queries that are broadcast at a time.
BATCH_BYTES = 8 << 20
#: Integers below this size are added without loss in 64 bits.
SAFE = 2.0**50
LONG = np.iinfo(np.int64)

BLOCK_SCHEMA = ("dim int, ids array<long>, kind string, exact binary, shift int, bits int, low binary, slices binary")


def usable(v: Column) -> Column:
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); Python integers where 64 bits would not do."""
    if x.size == 0 or np.abs(x).max() * scale < SAFE:
        return np.floor(scale * x).astype(np.int64)
    flat = [math.floor(v * scale) if abs(v) < SAFE else int(v) * scale for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held within 64 bits."""
    if rows.dtype != object and query.dtype != object and rows.shape[1]:
        if float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum()) < 2.0**62:
            return rows.astype(np.int64) @ query
    total = rows.astype(object) @ query.astype(object) if rows.shape[1] else np.zeros(len(rows), dtype=object)
    return np.array([min(max(int(t), LONG.min), LONG.max) for t in total], dtype=np.int64)


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words, the rest of the last word zero."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)])).view(np.uint64)


def rows_of(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def slice_block(values: np.ndarray, kept: int = SLICES) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(shift, bits, least value of each dimension, slices [bits, dimensions, words]) of integer rows."""
    low = values.min(axis=0)
    away = (values - low).astype(np.uint64)
    bits = int(away.max(initial=0)).bit_length()
    shift, bits = max(0, bits - kept), min(bits, kept)
    away >>= np.uint64(shift)
    planes = [bitmap(((away >> np.uint64(i)) & np.uint64(1)).T.astype(bool)) for i in range(bits)]
    return shift, bits, low, np.array(planes, dtype=np.uint64).reshape(bits, values.shape[1], -(-len(values) // 64))


def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ripple sum of two stacks of slices, least significant first; one slice more than the taller one."""
    if len(x) < len(y):
        x, y = y, x
    out = np.empty((len(x) + 1, *x.shape[1:]), dtype=np.uint64)
    carry = np.zeros(x.shape[1:], dtype=np.uint64)
    for i in range(len(x)):
        if i < len(y):
            half = x[i] ^ y[i]
            out[i] = half ^ carry
            carry = (x[i] & y[i]) | (half & carry)
        else:
            out[i] = x[i] ^ carry
            carry = x[i] & carry
    out[-1] = carry
    return out


def tree_sum(stack: np.ndarray) -> np.ndarray:
    """Sum over the second axis of [bits, addends, words]."""
    while stack.shape[1] > 1:
        odd = stack[:, -1:] if stack.shape[1] % 2 else None
        even = stack.shape[1] - (odd is not None)
        summed = add(stack[:, 0:even:2], stack[:, 1:even:2])
        if odd is not None:
            odd = np.concatenate([odd, np.zeros((1, *odd.shape[1:]), dtype=np.uint64)])
            summed = np.concatenate([summed, odd], axis=1)
        stack = summed
    return stack[:, 0]


def weighted_sum(both: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Slices of the sum of |weight| times (slices or, under a negative weight, their complement).

    ``both`` holds the slices of all dimensions, then their complements.
    """
    weight, dims = np.abs(query), len(query)
    source = np.arange(dims) + np.where(query < 0, dims, 0)
    total = np.zeros((1, both.shape[2]), dtype=np.uint64)
    for bit in range(int(weight.max(initial=0)).bit_length() - 1, -1, -1):
        total = np.concatenate([np.zeros((1, total.shape[1]), dtype=np.uint64), total])
        chosen = source[(weight >> bit) & 1 == 1]
        if len(chosen):
            total = add(total, tree_sum(both[:, chosen]))
    return total


def greatest(total: np.ndarray, among: np.ndarray, k: int) -> int:
    """The k-th greatest sum among the marked rows, found from the top slice down (k at most their number)."""
    value, above = 0, 0
    for i in range(len(total) - 1, -1, -1):
        with_bit = among & total[i]
        n = int(np.bitwise_count(with_bit).sum())
        if above + n >= k:
            value |= 1 << i
            among = with_bit
        else:
            above += n
            among = among & ~total[i]
    return value


def at_least(total: np.ndarray, among: np.ndarray, least: int) -> np.ndarray:
    """The marked rows whose sum is not below ``least``."""
    if least <= 0:
        return among
    if least.bit_length() > len(total):
        return np.zeros_like(among)
    above, equal = np.zeros_like(among), among
    for i in range(len(total) - 1, -1, -1):
        if least >> i & 1:
            equal = equal & total[i]
        else:
            above = above | (equal & total[i])
            equal = equal & ~total[i]
    return above | equal


class Block:
    """The slices and the integers of some rows."""

    def __init__(self, row: dict):
        self.ids = np.array([0 if i is None else i for i in row["ids"]], dtype=np.int64)
        self.unnamed = np.array([i is None for i in row["ids"]], dtype=bool)
        n, dim = len(self.ids), row["dim"]
        raw = np.frombuffer(row["exact"], dtype=row["kind"]).reshape(n, dim)
        self.wide = row["kind"] == "float64"
        self.values = integers(raw) if self.wide else raw
        self.all = bitmap(np.ones(n, dtype=bool))
        if not self.wide:
            self.shift, self.low = row["shift"], np.frombuffer(row["low"], dtype=np.int64)
            slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(row["bits"], dim, len(self.all))
            self.both = np.concatenate([slices, ~slices], axis=1)
            self.top = (1 << (row["bits"] + self.shift)) - 1

    def boundary(self, query: np.ndarray, own: int, k: int, floor: int | None) -> np.ndarray:
        """Rows that may be among the k best, or reach ``floor``, the k-th best score known so far."""
        mine = (self.ids == own) & ~self.unnamed
        among = self.all & ~bitmap(mine) if mine.any() else self.all
        found = len(self.ids) - int(mine.sum())
        if self.wide or query.dtype == object or not len(query) or found <= k and floor is None:
            return rows_of(among)
        total = weighted_sum(self.both, query)
        weight = np.abs(query)
        loose = int(weight.sum()) * ((1 << self.shift) - 1)  # what the bits left out can add
        least = 0
        if found > k:
            least = math.ceil(greatest(total, among, k) - loose / (1 << self.shift))
        if floor is not None:
            constant = int((query * self.low).sum()) - self.top * int(weight[query < 0].sum())
            least = max(least, -((constant + loose - floor) // (1 << self.shift)))
        return rows_of(at_least(total, among, least))


def build_index(vectors: DataFrame, vec_id: str, embedding: str, path: str, scale: int = SCALE, block: int = BLOCK) -> None:
    """Write the blocks of all usable vectors as a table."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[starts[rows][:, None] + np.arange(dim)]
                held = waiting.setdefault(dim, [[], []])
                held[0] += [ids[i] for i in rows]
                held[1].append(x)
                while len(held[0]) >= block:
                    x = np.concatenate(held[1])
                    yield packed(held[0][:block], x[:block])
                    held[0], held[1] = held[0][block:], [x[block:]]
        for ids, parts in waiting.values():
            if ids:
                yield packed(ids, np.concatenate(parts))

    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        values = integers(x, scale)
        row = {"dim": x.shape[1], "ids": ids, "kind": "float64", "exact": x.tobytes(), "shift": 0, "bits": 0, "low": b"", "slices": b""}
        if values.dtype != object:
            shift, bits, low, slices = slice_block(values)
            small = values.astype(np.min_scalar_type(-1 - int(np.abs(values).max(initial=0))))
            row |= {"kind": small.dtype.name, "exact": small.tobytes(), "shift": shift, "bits": bits,
                    "low": low.tobytes(), "slices": slices.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=layout)

    layout = pa.schema([("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("exact", pa.binary()),
                        ("shift", pa.int32()), ("bits", pa.int32()), ("low", pa.binary()), ("slices", pa.binary())])
    rows = vectors.where(usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("i"), F.col(embedding).alias("v"))
    rows.mapInArrow(cut, BLOCK_SCHEMA).write.parquet(path)


def _search(shared, k: int, scale: int):
    """From blocks: (q, query_id, vec_id, score) of the k best rows of the task for every query of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, owners, vectors = shared.value
        asked = [integers(np.array(v, dtype=np.float64), scale) for v in vectors]
        best: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for at, query in enumerate(asked):
                    if len(query) == block.values.shape[1]:
                        best[at] = merged(best.get(at), block, query, owners[at])
        for at, (score, ids, unnamed) in best.items():
            names = pa.array(ids, pa.int64(), mask=unnamed)
            n = len(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([numbers[at]] * n, pa.int64()), pa.array([owners[at]] * n, pa.int64()), names, pa.array(score, pa.int64())],
                names=["q", "query_id", "vec_id", "score"])

    def merged(kept: tuple | None, block: Block, query: np.ndarray, own: int) -> tuple:
        floor = int(kept[0][k - 1]) if kept is not None and len(kept[0]) == k else None
        rows = block.boundary(query, own, k, floor)
        found = (products(block.values[rows], query), block.ids[rows], block.unnamed[rows])
        if kept is not None:
            found = tuple(np.concatenate(pair) for pair in zip(kept, found, strict=True))
        # ~score falls as the score rises and, unlike its negative, never overflows.
        order = np.lexsort((found[1], found[2], ~found[0]))[:k]
        return tuple(column[order] for column in found)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = SCALE, block: int = BLOCK, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row that ``queries`` holds for."""
    spark = vectors.sparkSession
    folder = scratch_path(spark, f"slices-{uuid.uuid4().hex[:8]}")
    build_index(vectors, vec_id, embedding, f"{folder}/index", scale, block)
    asked = vectors.where(queries & F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).alias("v"), F.monotonically_increasing_id().alias("q"))
    asked.write.parquet(f"{folder}/queries")
    asked = spark.read.parquet(f"{folder}/queries")
    size = asked.agg(F.sum(32 + 8 * F.size("v"))).first()[0] or 0
    n = max(1, math.ceil(size / batch_bytes))
    index = spark.read.parquet(f"{folder}/index")
    if n > 1:
        asked.withColumn("batch", F.pmod(F.xxhash64("q"), F.lit(n))).repartition(n, "batch").write.partitionBy("batch").parquet(f"{folder}/batches")
    for i in range(n):  # one batch of queries at a time reaches the driver
        part = asked if n == 1 else spark.read.parquet(f"{folder}/batches").where(F.col("batch") == i)
        rows = part.select("q", "query_id", "v").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        index.mapInArrow(_search(shared, k, scale), "q long, query_id long, vec_id long, score long").write.mode("append").parquet(f"{folder}/partial")
        shared.destroy()
    if size == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = spark.read.parquet(f"{folder}/partial").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
