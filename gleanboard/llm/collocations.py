"""Phrase collocations counted over a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation, pieces into words. A piece is parsed
into chunks: a chunk begins where the hash of the next ``longest - 1`` words is
divisible by ``trigger`` (or after MOST_WORDS words without such a place) and
reaches over the trigger words of its successor. Where a chunk begins depends on
the words alone, so equal passages give equal chunks wherever they stand, and
the corpus becomes a dictionary of distinct chunks with frequencies. Phrases are
counted inside distinct chunks, weighted with their frequency. A phrase belongs to
the chunk that owns its first word; the overlap belongs to the successor and is
long enough for every phrase that begins before it, so each occurrence is counted
once.

Counting goes length by length. A phrase can only be frequent if both phrases of
one word less in it are; a bitmap of the frequent ones (a bit for each hash, of
bounded size) is sent to the tasks, which leave out what it excludes. Once the
frequent pairs are known the dictionary is cut down to the runs that such pairs
form, and longer phrases are counted in these, first in buckets of hashes (Park,
Chen and Yu's hash table): a task sends the sums of its buckets, packed, and only
phrases of buckets that hold ``least`` occurrences in all become rows. Most longer
phrases whose parts are frequent are rare themselves and never leave their task. A
false hit of a bitmap costs a row and changes no count.

Defined results: a null text is empty; a null language is UNKNOWN; rows that
repeat count as often as they occur; texts and pieces of any length are parsed
whole; words are compared by their bytes; ties in score fall to the greater count
and then to the smaller phrase; an empty table gives an empty result; other
columns are not read. Scores are exact (38 digits before the division). Within a
slice of a task equal 64-bit hashes stand for equal phrases; counts of tasks are
summed by the phrases themselves.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k_per_group
from ..session import bounded_batches, scratch_path
from .words import U, WordHasher, mix, mix_one, shingles

UNKNOWN = "und"
LONGEST = 5
LEAST = 100
KEPT = 2000
TRIGGER = 16
#: A chunk owns so many words at most; where none of them triggers it ends all the same.
MOST_WORDS = 64
#: Bytes that are parsed or counted at a time; a longer text is parsed alone.
SLICE_BYTES = 4_000_000
#: Chunks or words that a task gathers before it hands them on.
HELD_ROWS = 300_000
#: Bits of a bitmap: 256 for each phrase in it, within these bounds (4 KB and 32 MB).
BITS_A_PHRASE, LEAST_BITS, MOST_BITS = 256, 1 << 15, 1 << 28
#: Occurrences that a bucket may hold on average, the least number of buckets, the most bytes of them all, and the parts they are summed in.
BUCKET_LOAD, LEAST_BUCKETS, MOST_BUCKET_BYTES, BUCKET_PARTS = 16, 1 << 15, 1 << 26, 256
PUNCTUATION = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + PUNCTUATION, bytes(range(97, 123)) + b" " + b"\n" * len(PUNCTUATION))
SPACES = re.compile(b" {2,}")


class Parser:
    """Cuts texts into chunks: (chunk, words that it owns), and tells their words."""

    def __init__(self, longest: int = LONGEST, trigger: int = TRIGGER, most: int = MOST_WORDS):
        self.reach, self.trigger, self.most = longest - 1, trigger, most
        self.hasher = WordHasher(lower=False)

    def __call__(self, texts: list[str]) -> tuple[list[tuple[bytes, int]], _Words]:
        data = b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(PLAIN)
        words = _Words(SPACES.sub(b" ", data), self.hasher)
        count = len(words.start)
        if not count:
            return [], words
        first = np.flatnonzero(np.diff(words.piece, prepend=-1))
        place = np.arange(count)
        last = np.repeat(np.append(first[1:], count), np.diff(np.append(first, count)))
        begins = np.zeros(count, dtype=bool)
        begins[first] = True
        if self.reach:
            window = shingles(words.hash, self.reach) % U(self.trigger) == 0
            begins[: len(window)] |= window & (place[: len(window)] + self.reach <= last[: len(window)])
        else:
            begins |= words.hash % U(self.trigger) == 0
        at = np.flatnonzero(begins)
        since = place - np.repeat(at, np.diff(np.append(at, count)))
        at = np.flatnonzero(begins | (since % self.most == 0))
        owned = np.diff(np.append(at, count))
        final = np.minimum(at + owned + self.reach, last[at]) - 1
        return list(zip(words.texts(at, final), owned.tolist(), strict=True)), words


class _Words:
    """The words of some bytes: pieces are lines, words are parted by one space or more."""

    def __init__(self, data: bytes, hasher: WordHasher):
        self.data = data
        byte = np.frombuffer(data, dtype=np.uint8)
        line = byte == 10
        edge = np.flatnonzero(np.diff((line | (byte == 32)).view(np.int8), prepend=1, append=1))
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(line), self.start)
        self.hash = hasher.words(byte, self.start, self.end)

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """What stands from one word to another of the same piece."""
        data = self.data
        return [data[a:b] for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)]

    def phrases(self, width: int, lang: str) -> np.ndarray:
        """A hash of the phrase of ``width`` words at every place, other ones in other languages."""
        return mix(shingles(self.hash, width) ^ U(mix_one(zlib.crc32(lang.encode()))))


def dictionary(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", longest: int = LONGEST, trigger: int = TRIGGER) -> None:
    """Writes the distinct chunks of the corpus and its words, each with how often it occurs.

    Rows: (lang, chunk, owned, h, weight), in the folders kind=chunk and kind=word; a
    word's row holds its hash, a chunk's the number of words that it owns.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, chunks, words = Parser(longest, trigger), Counter(), Counter()
        for batch in batches:
            texts, langs = batch.column(1), batch.column(0).to_pylist()
            by_lang: dict[str, list[int]] = {}
            for i, name in enumerate(langs):
                by_lang.setdefault(name, []).append(i)
            for name, rows in by_lang.items():
                part, size = [], 0
                for j, i in enumerate(rows):
                    part.append(texts[i].as_py())
                    size += len(part[-1])
                    if size >= SLICE_BYTES or j == len(rows) - 1:
                        cut, found = parser(part)
                        chunks.update((name, chunk, own) for chunk, own in cut)
                        texts_of, h, n = counted(found.phrases(1, name), found, 1)
                        for word, h_of, times in zip(texts_of, h.tolist(), n.tolist(), strict=True):
                            words[name, word, h_of] += times
                        part, size = [], 0
                        if len(chunks) >= HELD_ROWS or len(words) >= HELD_ROWS:
                            yield from handed(chunks, words)
                            chunks, words = Counter(), Counter()
        yield from handed(chunks, words)

    def handed(chunks: Counter, words: Counter) -> Iterator[pa.RecordBatch]:
        for kind, held in (("chunk", chunks), ("word", words)):
            if held:
                names, texts, numbers = zip(*held, strict=True)
                zero, numbers = pa.array(np.zeros(len(held), dtype=np.int64)), pa.array(numbers, pa.int64())
                owned, h = (numbers, zero) if kind == "chunk" else (zero, numbers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(held)), pa.array(names, pa.string()), pa.array(texts, pa.binary()), owned, h,
                     pa.array(held.values(), pa.int64())], names=["kind", "lang", "chunk", "owned", "h", "weight"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    parsed = rows.mapInArrow(parse, "kind string, lang string, chunk binary, owned long, h long, weight long")
    summed = parsed.groupBy("kind", "lang", "chunk", "owned", "h").agg(F.sum("weight").alias("weight"))
    summed.write.partitionBy("kind").parquet(path)


def counted(h: np.ndarray, words: _Words, width: int, at: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different phrases at some places, or at all, with their hashes and times."""
    h = h if at is None else h[at]
    if not len(h):
        return [], h.view(np.int64), h.view(np.int64)
    if weight is None:
        values, first, times = np.unique(h, return_index=True, return_counts=True)
    else:
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.diff(h[order], prepend=~h[order[0]]))
        values, first, times = h[order[begin]], order[begin], np.add.reduceat(weight[order], begin)
    place = first if at is None else at[first]
    return words.texts(place, place + width - 1), values.view(np.int64), times


def frequent_bitmap(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes of frequent phrases; a power of two of them, bounded whatever the corpus."""
    wanted = BITS_A_PHRASE * max(1, frequent.count())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    parts = frequent.groupBy(F.shiftright(place, 15).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("map"))
    out = np.zeros((bits >> 15, 1 << 12), dtype=np.uint8)
    for row in parts.collect():
        out[row["part"]] = np.frombuffer(row["map"], dtype=np.uint8)
    return out.reshape(-1)


def hit(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = h & U(8 * len(bitmap) - 1)
    return ((bitmap[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1).astype(bool)


class _Chunks(_Words):
    """The words of some chunks of one language."""

    def __init__(self, lang: str, chunks: list[bytes], owned: np.ndarray, weight: np.ndarray, hasher: WordHasher):
        super().__init__(b"\n".join(chunks), hasher)
        self.lang = lang
        sizes = np.bincount(self.piece, minlength=len(chunks))
        inside = np.arange(len(self.piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left, self.own, self.weight = sizes[self.piece] - inside, owned[self.piece] - inside, weight[self.piece]

    def frequent(self, width: int, bitmap: np.ndarray) -> np.ndarray:
        """Whether a phrase of ``width`` words that may be frequent begins at each place (and one place more)."""
        out = np.zeros(len(self.hash) + 1, dtype=bool)
        h = self.phrases(width, self.lang)
        out[: len(h)] = hit(h, bitmap) & (self.left[: len(h)] >= width)
        return out

    def places(self, width: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all phrases, where those begin whose parts of one word less may both be frequent)."""
        parts = self.frequent(width - 1, bitmap)
        return self.phrases(width, self.lang), np.flatnonzero(parts[:-1] & parts[1:] & (self.left >= width) & (self.own > 0))

    def count(self, width: int, bitmap: np.ndarray, buckets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(phrase, hash, times) of the phrases of such places whose bucket is full enough."""
        h, at = self.places(width, bitmap)
        at = at[hit(h[at], buckets)]
        return counted(h, self, width, at, self.weight[at])

    def runs(self, bitmap: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(run, words that it owns, weight): the longest runs of three or more words in which all neighbours are frequent pairs."""
        edge = np.flatnonzero(np.diff(self.frequent(2, bitmap).view(np.int8), prepend=0))
        start, end = edge[0::2], edge[1::2]  # the pairs at start .. end - 1 reach to the word at end
        own = np.minimum(self.own[start], end + 1 - start)
        some = np.flatnonzero((end - start >= 2) & (own > 0))
        return self.texts(start[some], end[some]), own[some], self.weight[start[some]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunks]:
    """Parts of the dictionary of bounded bytes, each of one language."""
    hasher, held, size = WordHasher(lower=False), {}, 0

    def done() -> Iterator[_Chunks]:
        for lang, (found, owned, weight) in held.items():
            yield _Chunks(lang, found, np.concatenate(owned), np.concatenate(weight), hasher)

    for batch in batches:
        chunks, langs = batch.column("chunk").to_pylist(), batch.column("lang").dictionary_encode()
        owned, weight = (batch.column(c).to_numpy() for c in ("owned", "weight"))
        code, names_of = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        for i, lang in enumerate(names_of):
            part = held.setdefault(lang, ([], [], []))
            rows = slice(None) if len(names_of) == 1 else np.flatnonzero(code == i)
            part[0].extend(chunks if len(names_of) == 1 else [chunks[r] for r in rows.tolist()])
            part[1].append(owned[rows])
            part[2].append(weight[rows])
        size += batch.column("chunk").nbytes
        if size >= SLICE_BYTES:
            yield from done()
            held, size = {}, 0
    yield from done()


def _by_slices(chunks: DataFrame, rows_of, schema: str, held_rows: int = 0) -> DataFrame:
    """``rows_of(part)`` for parts of the dictionary of bounded bytes: (text, number, number) behind the language.

    With ``held_rows`` a task gathers about so many rows and sums their last number before it hands them on.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], int] = {}
        for part in _slices(batches):
            texts, x, y = rows_of(part)
            if not held_rows:
                yield from made([part.lang] * len(texts), texts, x, y)
                continue
            for text, of, times in zip(texts, x.tolist(), y.tolist(), strict=True):
                held[part.lang, text, of] = held.get((part.lang, text, of), 0) + times
            if len(held) >= held_rows:
                yield from made(*zip(*held, strict=True), list(held.values()))
                held = {}
        if held:
            yield from made(*zip(*held, strict=True), list(held.values()))

    def made(*columns) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return chunks.mapInArrow(run, schema)


def full_buckets(chunks: DataFrame, width: int, bitmap: np.ndarray, least: int) -> np.ndarray:
    """Bits of the buckets of hashes in which such phrases of ``width`` words occur ``least`` times together.

    Sums stop at ``least``, so a bucket takes a byte for the usual ones. There is a
    bucket for every BUCKET_LOAD words up to a bounded number; beyond it more rare phrases pass.
    """
    kind = np.min_scalar_type(least)
    words = chunks.agg(F.sum(F.col("owned") * F.col("weight").cast("double"))).first()[0] or 0
    count = max(LEAST_BUCKETS, min(MOST_BUCKET_BYTES // kind.itemsize, 1 << int(words / BUCKET_LOAD).bit_length()))
    size = count // BUCKET_PARTS
    shared = chunks.sparkSession.sparkContext.broadcast(bitmap)

    def add(held: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> None:
        held[bucket] = np.minimum(held[bucket].astype(np.int64) + times, least)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(count, dtype=kind)
        for part in _slices(batches):
            h, at = part.places(width, shared.value)
            if len(at):
                bucket = (h[at] & U(count - 1)).astype(np.uint32)
                order = np.argsort(bucket)
                bucket = bucket[order]
                begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                add(held, bucket[begin], np.add.reduceat(np.minimum(part.weight[at], least)[order], begin))
        some = np.flatnonzero(held)
        edge = np.searchsorted(some, np.arange(BUCKET_PARTS + 1) * size)
        for i in np.flatnonzero(np.diff(edge)).tolist():
            at = some[edge[i]: edge[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([(at - i * size).astype(np.uint32).tobytes()], pa.binary()), pa.array([held[at].tobytes()], pa.binary())],
                names=["part", "bucket", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bucket, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i not in sums:
                    sums[i] = np.zeros(size, dtype=kind)
                add(sums[i], np.frombuffer(bucket, dtype=np.uint32), np.frombuffer(n, dtype=kind).astype(np.int64))
        for i, held in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "map"])

    parts = chunks.mapInArrow(buckets, "part int, bucket binary, n binary").repartition("part").mapInArrow(summed, "part int, map binary")
    out = np.zeros((BUCKET_PARTS, size // 8), dtype=np.uint8)
    for row in parts.collect():
        out[row["part"]] = np.frombuffer(row["map"], dtype=np.uint8)
    return out.reshape(-1)


def phrase_counts(chunks: DataFrame, width: int, bitmap: np.ndarray, least: int) -> DataFrame:
    """(lang, phrase, h, n) of the phrases of ``width`` words that occur ``least`` times, and of some that occur less.

    Neither the bitmap of the shorter ones nor the buckets exclude one that does. Pairs have
    no buckets (one more pass over the whole dictionary), so few of them repeat in a task
    and they are handed on as they come.
    """
    buckets = full_buckets(chunks, width, bitmap, least) if width > 2 else np.full(1, 255, dtype=np.uint8)
    shared = chunks.sparkSession.sparkContext.broadcast((bitmap, buckets))
    rows = _by_slices(chunks, lambda part: part.count(width, *shared.value), "lang string, phrase binary, h long, n long",
                      HELD_ROWS if width > 2 else 0)
    return rows.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))


def pruned(chunks: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The dictionary without what cannot hold a frequent phrase of three words."""
    shared = chunks.sparkSession.sparkContext.broadcast(bitmap)
    rows = _by_slices(chunks, lambda part: part.runs(shared.value), "lang string, chunk binary, owned long, weight long")
    return rows.groupBy("lang", "chunk", "owned").agg(F.sum("weight").alias("weight"))


def _part(first: Column | int, words: Column | int) -> Column:
    return F.array_join(F.slice("words", first, words), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 kept: int = KEPT, covered: int = 100, trigger: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``kept`` best phrases of every language.

    A phrase of 2 to ``longest`` words that occurs ``least`` times scores
    floor(1000 * a * n / (l * r)) at its weakest cut. One that lies in a longer such
    phrase with at least ``covered`` percent of its count is left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, f"phrases-{uuid.uuid4().hex[:8]}")
    dictionary(docs, f"{folder}/parse", text, lang, longest, trigger)
    schema = "lang string, chunk binary, owned long, h long, weight long"
    parsed = spark.read.schema(schema + ", kind string").parquet(f"{folder}/parse")
    chunks, words = (parsed.where(F.col("kind") == kind).drop("kind") for kind in ("chunk", "word"))
    counted = chunks
    for width in range(1, longest + 1):
        if width == 3:
            pruned(chunks, bitmap).write.parquet(f"{folder}/runs")
            counted = spark.read.parquet(f"{folder}/runs")
        rows = phrase_counts(counted, width, bitmap, least) if width > 1 else words.withColumnsRenamed({"chunk": "phrase", "weight": "n"})
        rows.where(F.col("n") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), "h", "n").write.parquet(
            f"{folder}/counts/width={width}")
        if width < longest:
            bitmap = frequent_bitmap(spark.read.parquet(f"{folder}/counts/width={width}"))
    counts = spark.read.parquet(*[f"{folder}/counts/width={w}" for w in range(1, longest + 1)]).drop("h")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("weight")).alias("total"))

    candidates = counts.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), "words",
                            F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"),
        _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    scored = (cut.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
              .join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
              .join(totals, "lang"))
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "total", "l", "r")}
    scored = scored.withColumns({f"_{c}": v for c, v in exact.items()}).withColumn(
        "score", F.expr("(_a * _total * 1000) div (_l * _r)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r", "total")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score")

    # Every phrase inside a longer candidate, with the greatest count of such a one.
    inner = reduce(lambda x, y: x.unionByName(y), [
        candidates.where(F.size("words") > w).select(
            "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - w + 1), lambda i: F.array_join(F.slice("words", i, w), " "))).alias("phrase"),  # noqa: B023
            F.col("n").alias("around"))
        for w in range(2, longest)]) if longest > 2 else None
    if inner is not None:
        around = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        weakest = weakest.join(around, ["lang", "phrase"], "left").where(
            F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True))).drop("around")
    best = top_k_per_group(weakest, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], kept)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
