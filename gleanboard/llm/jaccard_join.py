"""N-gram Jaccard join by parity sketches: exact, without pairs of a whole group.

A document is the set of its distinct word shingles. Every shingle flips bits
of one block of a sketch (one bit of the whole sketch that is compared later, a
64-bit hash of the blocks that are joined on), so a set difference of d shingles
touches at most d blocks and at most d bits of the whole sketch. For a Jaccard similarity of t, sizes are within a factor t and
d <= (a + b)(1 - t)/(1 + t). Documents are put into bands of similar size; a
band cuts its sketch into more than d blocks, and of the blocks with two shingles
or more, in one order for all, d + 1 are keys: two similar documents share a key.

Shingles that many documents hold are left out of the sketch (any fixed set of
shingles may be: it can only lower the difference), so a passage that a third
of all documents share makes no keys. Documents with too few other shingles
also give the blocks of their whole set; tiny ones single shingles.

Keys meet in a sort; in each bucket every document is held against the smallest
one (a star, not all pairs), and only documents that the verified links leave in
different components of a bucket are held against each other, after the whole
sketches' distance has been checked. Verification counts the shared shingles of
the two whole sets (64-bit hashes).

Defined results: null or wordless texts have an empty set and link with
nothing; equal sets are one node; a null id is kept, and counts for nothing in
the smallest id of a group; repeated rows are each returned; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_batches, scratch_path, settle
from . import graph
from .words import U, WordHasher, mix, mix_one, shingle_sets

#: Least length of a whole sketch, in words of 64 bits; it grows with the set, two bits for a shingle.
SKETCH_WORDS = 4
BAND = 1.6
#: A shingle in more than one of so many documents stays out of the sketches; at most
#: COMMON x the mean set size of such shingles can exist, whatever the corpus holds.
COMMON = 1000
#: An open bucket is cut into blocks of about so many nodes.
BLOCK = 2000


def _bands() -> list[int]:
    edges = [1]
    while edges[-1] < 2**40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


class Keys:
    """The keys of a shingle set."""

    def __init__(self, share: float, common: np.ndarray):
        """``share``: the least Jaccard similarity; ``common``: sorted shingles left out."""
        self.share, self.common, self.edges = share, common, _bands()
        self.differ = (1 - share) / (1 + share)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n == 0:
            return np.zeros(0, dtype=np.int64)
        rare = s
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            rare = s[self.common[at] != s]
        band = bisect_right(self.edges, n) - 1
        out = self._layout(s, rare, band, int((n + n / self.share) * self.differ + 1e-9))
        for lower in range(band - 1, -1, -1):  # partners in the bands below
            most = self.edges[lower + 1] - 1
            if most < self.share * n - 1e-9:
                break
            out += self._layout(s, rare, lower, int((n + most) * self.differ + 1e-9))
        return np.unique(np.concatenate(out)).view(np.int64)

    def _layout(self, s: np.ndarray, rare: np.ndarray, band: int, d: int) -> list[np.ndarray]:
        # 1.3 to 2.6 shingles a block over all sizes that use the layout: there the most blocks have two.
        blocks = int(1.92 * (1 + 1 / self.share) * self.differ * self.edges[band + 1]) + 2
        # From the most telling keys to the least: a document goes on while it has d keys or fewer.
        # Of two similar ones, one that stopped earlier has more than d, so they meet there.
        out = []
        for step, (some, least) in enumerate(((rare, 2), (rare, 2), (rare, 2), (rare, 1), (s, 1))):
            keys = self._blocks(some, blocks, least, mix_one(8 * band + step))
            out.append(_prefix(keys, d + 1))
            if len(keys) > d:
                return out
        out.append(_prefix(mix(s ^ U(mix_one(8 * band + 7))), len(s) - int(np.ceil(self.share * len(s) - 1e-9)) + 1))
        return out

    def _blocks(self, s: np.ndarray, blocks: int, least: int, salt: int) -> np.ndarray:
        """A key for every block with so many shingles: the XOR of their hashes."""
        h = mix(s ^ U(salt))
        place = ((h >> U(32)) * U(blocks)) >> U(32)
        order = np.argsort(place, kind="stable")
        place, h = place[order], mix(h[order])
        start = np.flatnonzero(np.diff(place, prepend=U(blocks)))
        if not len(start):
            return h
        words = np.bitwise_xor.reduceat(h, start)
        full = np.diff(np.append(start, len(h))) >= least
        return mix(words[full] + mix(place[start][full] + U(salt)))


def parity(s: np.ndarray, words: int, salt: int) -> np.ndarray:
    """``words`` 64-bit words in which every shingle has flipped one bit."""
    bits = 64 * words
    h = mix(s ^ U(salt))
    at = h & U(bits - 1) if words & (words - 1) == 0 else ((h >> U(32)) * U(bits)) >> U(32)
    odd = np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U)


def sketch(s: np.ndarray) -> bytes:
    """The whole sketch: a power of two of words, so that a longer one folds into a shorter one."""
    words = SKETCH_WORDS
    while 32 * words < len(s):
        words *= 2
    return parity(s, words, 99).tobytes()


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, at the length of the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _prefix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys if len(keys) <= n else np.partition(keys, n - 1)[:n]


def fingerprint(s: np.ndarray) -> int:
    """The node of a shingle set."""
    with np.errstate(over="ignore"):
        total = int(mix(s + U(0x632BE59BD9B4E019)).sum(dtype=U)) if len(s) else 0
    return int(np.array([mix_one(total ^ (len(s) << 1))], dtype=U).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, hasher: WordHasher, width: int) -> Iterator[np.ndarray]:
    return shingle_sets(*hasher(batch.column("text").to_pylist()), width)


def _profile(width: int):
    """Per document its size, node and sketch; per task the shingles that are common in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, often = WordHasher(lower=True), Frequent()
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for s in _sets(batch, hasher, width):
                sizes.append(len(s))
                nodes.append(fingerprint(s) if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
                often.add(s)
            yield _rows(batch.column("doc_id"), batch.column("h"), sizes, nodes, sketches)
        keys, counts = often.fold()
        none = pa.nulls(len(keys), pa.int64())
        yield _rows(none, none, counts.tolist(), keys.view(np.int64).tolist(), [b""] * len(keys))
    return run


class Frequent:
    """Lossy counting: what stays below one in 2 x COMMON documents of the task is forgotten.

    Sets are gathered up to HELD shingles and folded into the counts together.
    """

    HELD = 3_000_000

    def __init__(self):
        self.seen, self.held, self.sets = 0, 0, []
        self.keys, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)

    def add(self, s: np.ndarray) -> None:
        self.seen += 1
        self.held += len(s)
        self.sets.append(s)
        if self.held >= self.HELD:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.sets:
            new, counts = np.unique(np.concatenate(self.sets), return_counts=True)
            self.sets, self.held = [], 0
            both = np.concatenate([self.keys, new])
            counts = np.concatenate([self.counts, counts])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            total = np.add.reduceat(counts, first) if len(both) else counts
            stay = total > max(1.0, self.seen / (2 * COMMON))
            self.keys, self.counts = both[first][stay], total[stay]
        return self.keys, self.counts


def _rows(ids, texts, sizes, nodes, sketches) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), texts, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())],
        names=["doc_id", "h", "n", "node", "sketch"])


def _keys(width: int, share: float, common: np.ndarray):
    """(key, node, n) of every different set of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, keys_of, done = WordHasher(lower=True), Keys(share, common), set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for s in _sets(batch, hasher, width):
                node = fingerprint(s)
                if len(s) and node not in done:
                    done.add(node)
                    keys.append(keys_of(s))
                    nodes.append(node)
                    sizes.append(len(s))
            if keys:
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, dtype=np.int64), times)),
                     pa.array(np.repeat(np.array(sizes, dtype=np.int64), times))], names=["key", "node", "n"])
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, node): every further node of a key beside the key's first one."""
    last = None  # key, node, hub, hub's size
    for batch in batches:
        key, node, n = (batch.column(c).to_numpy() for c in ("key", "node", "n"))
        if not len(key):
            continue
        if last is not None:
            key, node, n = (np.concatenate([[x], y]) for x, y in ((last[0], key), (last[1], node), (0, n)))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        hub, hub_n = node[first], n[first]
        if last is not None:
            same = first == 0
            hub[same], hub_n[same] = last[2], last[3]
        further = ~fresh & np.concatenate([[False], node[1:] != node[:-1]])
        last = (key[-1], node[-1], hub[-1], hub_n[-1])
        if further.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[further]) for x in (key, hub, hub_n, node, n)], names=["key", "hub", "hub_n", "node", "n"])


def _shared(share_pct: int):
    """Links among pairs that carry both sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= share_pct * (len(x) + len(y) - both))
            links = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if links.num_rows:
                yield links
    return run


CELL = ["key", "lo", "hi", "part", "node", "component", "n", "sketch", "keys"]


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of open buckets dealt out so that every two nodes of a bucket meet in one pair of blocks (lo, hi)."""
    large = settle(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    rows = rows.join(F.broadcast(large), "key", "left")  # at most a row for BLOCK rows of open buckets
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).select(*CELL)


def _across(share_pct: int):
    """From rows in order of (key, lo, hi): pairs of different components whose sketches allow a link.

    A pair is written in the least of the open buckets that it shares only.
    """
    def pairs(cell: tuple, rows: list[tuple]) -> list[tuple]:
        _, lo, hi = cell
        part, node, comp, n, sketches, keys = zip(*rows, strict=True)
        part, node, comp, n = np.array(part), np.array(node), np.array(comp), np.array(n)
        bits = [np.frombuffer(x, dtype=U) for x in sketches]
        short = np.array([np.bitwise_xor.reduce(x.reshape(-1, SKETCH_WORDS), axis=0) for x in bits])  # all of one length
        found = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            if lo != hi:
                j = j[part[j] != part[i]]
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= share_pct * np.maximum(n[j], n[i]))]
            far = np.bitwise_count(short[j] ^ short[i]).sum(axis=1, dtype=np.int64)
            j = j[far * (100 + share_pct) <= (n[j] + n[i]) * (100 - share_pct)]
            far = np.array([distance(bits[i], bits[k]) for k in j], dtype=np.int64)
            j = j[far * (100 + share_pct) <= (n[j] + n[i]) * (100 - share_pct)]
            found += [(int(min(node[i], node[k])), int(max(node[i], node[k]))) for k in j if not len(np.intersect1d(keys[i], keys[k], assume_unique=True))]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, done = None, [], set()
        for batch in batches:
            # The lists of keys stay in their buffer: only those of surviving pairs are looked at.
            lists, flat = batch.column("keys").offsets.to_numpy(), batch.column("keys").values.to_numpy()
            keys = [flat[a:b] for a, b in zip(lists[:-1].tolist(), lists[1:].tolist(), strict=True)]
            for k, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in CELL[:-1]), keys, strict=True):
                if (k, lo, hi) != cell:
                    if len(rows) > 1:
                        done.update(pairs(cell, rows))
                    cell, rows = (k, lo, hi), []
                rows.append(row)
            if len(done) > 100_000:
                yield _pairs(done)
                done = set()
        if len(rows) > 1:
            done.update(pairs(cell, rows))
        if done:
            yield _pairs(done)
    return run


def _pairs(found: set) -> pa.RecordBatch:
    a, b = zip(*sorted(found), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _node_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            found = [(fingerprint(s), s.tobytes()) for s in _sets(batch, hasher, width) if len(s)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], names=["node", "set"])
    return run


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, share_pct: int = 80) -> DataFrame:
    """The rows of ``docs`` with one of each group: the smallest id, null last, and of equal ids the smallest hash of the text.

    A row that repeats is kept once. A document without words is a group of its own.
    """
    documents, _ = jaccard_groups(docs, doc_id, text, width, share_pct)
    documents = settle(documents.select("doc_id", "component", "h"))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    chosen = documents.where("component is not null").groupBy("component").agg(order).select(F.col("first.h").alias("_h"))
    chosen = chosen.union(documents.where("component is null").select("h")).distinct()
    rows = docs.withColumn("_own", row_hash(doc_id, text)).join(chosen, F.col("_own") == F.col("_h"), "left_semi")
    once = Window.partitionBy("_own").orderBy("_own")  # rows are in this order after the join
    return rows.withColumn("_copy", F.row_number().over(once)).where("_copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                   share_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: (doc_id, n_shingles, node, component_id, component, h), one row per
    input row; component_id is the smallest id that links reach, component tells
    groups apart that share it (repeated ids), h is a hash of the row's id and text. links: (a, b), verified
    links between nodes that connect every component.
    """
    spark = docs.sparkSession
    share = share_pct / 100
    bounded_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_hash(doc_id, text).alias("h"))
    folder = scratch_path(spark, f"jaccard-{uuid.uuid4().hex[:8]}")
    texts.mapInArrow(_profile(width), "doc_id long, h long, n long, node long, sketch binary").write.parquet(f"{folder}/profile")
    profile = spark.read.parquet(f"{folder}/profile")
    known = profile.where("sketch is null or length(sketch) > 0")
    nodes = known.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))

    limit = max(known.count() / COMMON, 3)
    often = (profile.where("length(sketch) = 0").groupBy("node").agg(F.sum("n").alias("n"))
             .where(F.col("n") > limit).select("node").collect())  # at most COMMON x the mean set size
    common = np.sort(np.array([r["node"] for r in often], dtype=np.int64).view(U))

    keys = texts.select("text").mapInArrow(_keys(width, share, common), "key long, node long, n long")
    (keys.repartition("key").sortWithinPartitions("key", "node")
     .mapInArrow(_stars, "key long, hub long, hub_n long, node long, n long").write.parquet(f"{folder}/buckets"))
    buckets = spark.read.parquet(f"{folder}/buckets")

    close = 100 * F.least("hub_n", "n") >= share_pct * F.greatest("hub_n", "n")
    stars = buckets.where(close).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = settle(_verify(_sketched(stars, nodes, share_pct), texts, nodes, width, share_pct))
    labels = graph.components(first, "a", "b")

    # Buckets that still hold several components.
    def labelled(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", column), column, "left").withColumn(
            "component", F.coalesce("component", column))

    every = labelled(buckets.select("key", "node"), "node")  # hubs have been held against all of these
    mixed = every.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_rows = settle(every.join(mixed, "key"))
    keys_of = open_rows.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most the keys of one document
    # A bucket needs the lesser keys of its rows only: half of what all of them would be.
    open_rows = open_rows.join(nodes.select("node", "n", "sketch"), "node").join(keys_of, "node").withColumn(
        "keys", F.filter("keys", lambda k: k < F.col("key")))
    crossing = (_cells(open_rows).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
                .mapInArrow(_across(share_pct), "a long, b long").distinct())
    second = settle(_verify(crossing.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
                                          ["a", "b"], "left_anti"), texts, nodes, width, share_pct))
    links = first.union(second)
    if not second.isEmpty():
        labels = graph.components(links, "a", "b")

    least = nodes.select("node", "doc_id").join(labels, "node").select("node", "doc_id", "component")
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    to = least.join(smallest, "component").select("node", "component_id", "component")
    own = nodes.select("node", F.col("doc_id").alias("own")).join(to, "node", "left").select(
        "node", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("component", "node").alias("component"))
    documents = known.join(own, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"), "component", "h")
    return documents, links


def _near(share_pct: int):
    """Pairs whose sketches differ in no more bits than similar sets may."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            far = np.array([distance(np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U))
                            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(far * (100 + share_pct) <= n * (100 - share_pct)))
    return run


def _sketched(pairs: DataFrame, nodes: DataFrame, share_pct: int) -> DataFrame:
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near(share_pct), "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, share_pct: int) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    pairs = settle(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = nodes.join(wanted, "node").select("doc_id").distinct()
    sets = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text").mapInArrow(_node_sets(width), "node long, set binary")
    sets = settle(sets.join(wanted, "node", "left_semi"))
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(_shared(share_pct), "a long, b long").distinct())
