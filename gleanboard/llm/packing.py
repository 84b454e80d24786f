"""Sequence packing by minimum bin slack.

A document's tokens are cut into full windows and one remainder. How remainders
share windows depends on their lengths only, so the lengths are counted (at most
``size`` rows, whatever the corpus) and one pattern of lengths after another is
chosen: starting from the longest remaining length, a subset-sum over a bitset
finds the lengths and counts that fill the window closest, and the pattern is
used as often as the counts allow, so that each step uses up a length. The rows
then find their place by their rank within their length: a range sort, not a
group.

Defined results: null text is an empty document of one end token; a repeated
row is packed again, a null id is kept; equal lengths are ordered by id, start
and checksum; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, scratch_path

SIZE = 4096
END = 2
#: Different words whose tokens a task remembers.
REMEMBERED = 400_000


class _Known(dict):
    """Values of keys, computed when a key is first asked for."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: bytes) -> bytes:
        self[key] = value = self.compute(key)
        return value


class WordTokens:
    """Token ids of whole texts, word by word, each different word once.

    Sound for tokenizers that cut at white space and drop it: a text's ids are
    the ids of its words in order. Of a word of ASCII and common Latin letters
    the steps before the model are plain (lower case, parts, byte letters), so
    its parts go to the tokenizer's model at once; any other word, and any that
    may hold a special token, takes the whole way.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Known(self._word)
        self.parts: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part if part.isascii() else "".join([self.letter[b] for b in part.encode()])
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(written)], dtype="<u4").tobytes()
            self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._part(word.lower().decode())
        text = word.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self._part(p) for p in self.PART.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").split()
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.parts.clear()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4")


def _pieces(path: str, size: int, end: int):
    """(doc_id, start, length, ids_crc32, doc_tokens) of full windows and remainders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(tokens(text or ""), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), size):
                    part = ids[start: start + size]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, count in one window)]) that use up ``counts`` with little slack."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        seed = order[0]
        room = size - seed
        # reach: bit r is set if some multiset of the lengths seen so far sums to r.
        reach, steps, goal = 1, [], 1 << room
        mask = (goal << 1) - 1
        for n in order:
            if reach & goal:
                break
            if n > room:
                continue
            have, unit = min(left[n] - (n == seed), room // n), 1
            while have > 0:
                take = min(unit, have)
                steps.append((reach, n, take))
                reach |= (reach << (n * take)) & mask
                have, unit = have - take, unit * 2
        rest = reach.bit_length() - 1
        chosen = {seed: 1}
        for before, n, take in reversed(steps):
            if not before >> rest & 1:
                chosen[n] = chosen.get(n, 0) + take
                rest -= n * take
        times = min(left[n] // c for n, c in chosen.items())
        out.append((times, sorted(chosen.items(), reverse=True)))
        for n, c in chosen.items():
            left[n] -= c * times
        order = [n for n in order if left[n]]
    return out


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first window, count in a window, offset): at most a few per pattern."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for times, chosen in plan:
        offset = 0
        for n, c in chosen:
            slots.setdefault(n, []).append((used.get(n, 0), window, c, offset))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        window += times
    return {n: np.array(v, dtype=np.int64) for n, v in slots.items()}


def _place(slots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rows = slots[n]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                inside = rank[at] - rows[k, 0]
                sequence[at] = rows[k, 1] + inside // rows[k, 2]
                offset[at] = rows[k, 3] + (inside % rows[k, 2]) * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch_path(spark, f"packing-{uuid.uuid4().hex[:8]}")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Written before the range sort, which reads its input twice.
    texts.mapInArrow(_pieces(tokenizer, size, end), SCHEMA).write.parquet(f"{folder}/cut")
    pieces = spark.read.parquet(f"{folder}/cut")
    order = ["length", "doc_id", "start", "ids_crc32"]
    # A range sort of narrow rows; a partition's rows are numbered in its order.
    (pieces.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(f"{folder}/pieces"))
    pieces = spark.read.parquet(f"{folder}/pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    rows = counted.collect()  # lengths are at most size, and a range partition holds consecutive ones
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], tuple[int, int]] = {}
    for r in sorted(rows, key=lambda r: (r["length"], r["part"])):
        before[r["part"], r["length"]] = (r["first"], counts.get(r["length"], 0))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    slots = _slots(patterns(counts, size))
    shift = spark.createDataFrame([(p, n, b - first) for (p, n), (first, b) in before.items()] or [(0, 0, 0)], "part int, length long, shift long")
    ranked = pieces.join(F.broadcast(shift), ["part", "length"]).withColumn("rank", F.col("row") + F.col("shift"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _place(slots), SCHEMA + ", sequence_id long, offset long")
