"""Substring dedup by recompression.

Rounds name runs of equal symbols and pairs of adjacent symbols; a name is a
hash of what it stands for, so every task gives equal content the same name
without asking another. Which pairs are merged depends on the two symbols only
(one half of all symbols may stand left, the other half right), so two equal
passages are named alike except for what lies near their edges. Every symbol
carries the stretch of words that its existence depends on; a window of words
is represented by a symbol whose stretch lies inside the window, of the highest
round that has one, so equal windows are represented by equal symbols wherever
they stand. A window without such a symbol (inside a long run) represents itself.

Consecutive windows of one symbol make a span. Spans of equal content are
settled by one aggregate; only where one symbol has spans of different content
are single windows compared, by hashes of all their words. A word goes if a
window over it also starts in a document with a smaller id, judged on the input.

Defined results: null or short texts have no windows and lose nothing; a null id
is neither a source nor cut; rows that repeat an id are judged each by its own
text and never against each other; an empty table gives an empty result; other
columns are not read. Hashes have 64 bits, and a symbol must agree with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, scratch_path
from .words import SLICE_BYTES, U, WordHasher, mix, mix_one

#: r names runs, p names pairs.
ROUNDS = "rppppp"
LONGEST_SYMBOL = 24


class Levels:
    """The symbols of one round: name, words they cover, words they depend on."""

    def __init__(self, name, start, length, low, high, edge):
        self.name, self.start, self.length, self.low, self.high, self.edge = name, start, length, low, high, edge

    def runs(self) -> Levels:
        fresh = np.ones(len(self.name), dtype=bool)
        fresh[1:] = (self.name[1:] != self.name[:-1]) | self.edge[1:] | self.edge[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(self.name)) - 1
        count = (last - first + 1).astype(U)
        name = np.where(count > 1, mix(self.name[first] + count * U(0xA24BAED4963EE407)), self.name[first])
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(self.name) - 1)
        edge = self.edge[first]
        return Levels(name, self.start[first], self.start[last] + self.length[last] - self.start[first],
                      np.where(edge, self.low[first], self.low[before]), np.where(edge, self.high[last], self.high[after]), edge)

    def pairs(self, salt: int) -> Levels:
        left = (mix(self.name ^ U(salt)) & U(1)).astype(bool)
        meet = np.zeros(len(self.name), dtype=bool)
        meet[:-1] = (left[:-1] & ~left[1:] & ~self.edge[:-1] & ~self.edge[1:]
                     & (self.length[:-1] + self.length[1:] <= LONGEST_SYMBOL))
        stay = np.ones(len(self.name), dtype=bool)
        stay[1:] = ~meet[:-1]
        i = np.flatnonzero(stay)
        m = meet[i]
        after, before = np.minimum(i + 1, len(self.name) - 1), np.maximum(i - 1, 0)
        name = np.where(m, mix(self.name[i] * U(0xD6E8FEB86659FD93) + self.name[after]), self.name[i])
        edge = self.edge[i]
        looks_right, looks_left = m | (left[i] & ~edge), ~m & ~left[i] & ~edge
        return Levels(name, self.start[i], self.length[i] + np.where(m, self.length[after], 0),
                      np.where(looks_left, self.low[before], self.low[i]), np.where(looks_right, self.high[after], self.high[i]), edge)


def represent(words: np.ndarray, bounds: np.ndarray, window: int):
    """(text, first window, windows, symbol, content) of every span of a batch of texts."""
    sizes = np.diff(bounds)
    at = np.arange(len(words)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)  # an edge stands before every text
    total = len(words) + len(sizes) + 1
    edge = np.ones(total, dtype=bool)
    edge[at] = False
    name = np.zeros(total, dtype=U)
    name[at] = words
    place = np.arange(total)
    level = Levels(name, place, np.ones(total, dtype=np.int64), place, place + 1, edge)
    levels = []
    for r, kind in enumerate(ROUNDS):
        level = level.runs() if kind == "r" else level.pairs(mix_one(1000 + r))
        levels.append(level)

    counts = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    w = first + (bounds[:-1] + np.arange(1, len(sizes) + 1))[text]
    symbol, anchor = np.zeros(len(w), dtype=U), np.full(len(w), -1)
    todo = np.arange(len(w))
    for r in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        level = levels[r]
        a = np.searchsorted(level.low, w[todo], "left")
        b = np.searchsorted(level.high, w[todo] + window, "right") - 1
        rank = mix(level.name ^ U(0x5BF03635))
        some = a <= b
        todo_now, a, b = todo[some], a[some], b[some]
        best = a.copy()
        k = 1
        live = np.flatnonzero(a + k <= b)
        while len(live):
            c = a[live] + k
            better = rank[c] < rank[best[live]]
            best[live[better]] = c[better]
            k += 1
            live = live[a[live] + k <= b[live]]
        symbol[todo_now] = mix(level.name[best] + U(r + 1))
        anchor[todo_now] = level.start[best] * len(levels) + r
        todo = todo[~some]

    power = WordPowers.of(total + 1)
    sums = np.zeros(total + 1, dtype=U)
    np.cumsum(name * power.up[:total], out=sums[1:], dtype=U)
    content = lambda s, e: mix((sums[e] - sums[s]) * power.down[s])
    symbol[todo] = content(w[todo], w[todo] + window)
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (anchor[1:] < 0)
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(w)))
    lead = np.where(anchor[head] < 0, 0, anchor[head] // len(levels) - w[head])
    inside = mix(content(w[head], w[head] + n + window - 1) + lead.astype(U) * U(0x9E3779B97F4A7C15) + n.astype(U))
    return text[head], first[head], n, symbol[head], inside


class WordPowers:
    """Powers of an odd base, grown when needed."""

    up = down = np.ones(1, dtype=U)

    @classmethod
    def of(cls, n: int) -> type[WordPowers]:
        if len(cls.up) < n:
            base = 0x9FB21C651E98DF25
            for name, r in (("up", base), ("down", pow(base, -1, 2**64))):
                steps = np.full(2 * n, U(r))
                steps[0] = U(1)
                setattr(cls, name, np.cumprod(steps, dtype=U))
        return cls


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES // 2:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Kinds of rows on their way to the task of their symbol: a span; a span of a symbol with many contents,
#: which goes by its content instead; a note that a symbol has such spans; a stretch that is known to go.
SPAN, SPREAD, NOTE, GONE = range(4)
MANY = 3
#: A span is shorter than its window, and ``_at`` has room for 1,023.
MOST_WINDOW = 1000
ROW = ["kind", "s", "h", "doc", "at"]
MET = "kind int, s long, doc long, at long"


def _at(tag: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Text tag (23 bits), first window (30 bits) and windows (10 bits) in one number."""
    return (tag.astype(np.int64) << 40) | (first.astype(np.int64) << 10) | n


def _combine(s: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray, spread: bool) -> pa.RecordBatch:
    """What a task sends on: of equal content only the smallest document; the others are settled here."""
    order = np.lexsort((doc, h, s))
    s, h, doc, at = s[order], h[order], doc[order], at[order]
    new_s = np.concatenate([[True], s[1:] != s[:-1]])
    new = new_s | np.concatenate([[True], h[1:] != h[:-1]])
    owner = doc[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    kind = np.where(doc > owner, GONE, SPAN).astype(np.int32)
    notes = np.zeros(0, dtype=np.int64)
    if spread:
        group = np.cumsum(new_s) - 1
        many = np.bincount(group, weights=new) >= MANY
        kind[(kind == SPAN) & many[group]] = SPREAD
        notes = s[new_s][many]
    gone = kind == GONE
    s = np.where(gone, mix(at.view(U) ^ doc.view(U)).view(np.int64), s)
    pad = np.zeros(len(notes), dtype=np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([kind, np.full(len(notes), NOTE, dtype=np.int32)])), pa.array(np.concatenate([s, notes])),
        pa.array(np.concatenate([h, pad])), pa.array(np.concatenate([doc, pad])), pa.array(np.concatenate([at, pad]))], names=ROW)


def _settle(keep_open: bool):
    """From rows in order of (s, h, doc, at): stretches to go, and the spans whose symbol has other contents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ROW]
            if rest is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[1], rows[1][-1], "left"))  # the last symbol may go on
            rest = [x[cut:] for x in rows]
            if cut:
                yield settled([x[:cut] for x in rows])
        if rest is not None and len(rest[0]):
            yield settled(rest)

    def settled(rows: list[np.ndarray]) -> pa.RecordBatch:
        kind, s, h, doc, at = rows
        new_s = np.concatenate([[True], s[1:] != s[:-1]])
        span = kind < NOTE
        new = new_s | np.concatenate([[True], (h[1:] != h[:-1]) | (span[1:] != span[:-1])])
        group = np.cumsum(new_s) - 1
        contested = (np.bincount(group, weights=new & span) > 1) | (np.bincount(group, weights=(kind == NOTE) | (kind == SPREAD)) > 0)
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        gone = (kind == GONE) | (span & (doc > doc[first]))
        # Every place of the smallest document is asked; a row that is there twice is asked once.
        again = ~new & np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
        asked = span & contested[group] & (doc == doc[first]) & ~again if keep_open else np.zeros(len(s), dtype=bool)
        some = np.flatnonzero(gone | asked)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(gone[some], GONE, SPAN).astype(np.int32)), pa.array(s[some]), pa.array(doc[some]), pa.array(at[some])],
            names=["kind", "s", "doc", "at"])
    return run


def _met(rows: DataFrame, keep_open: bool) -> DataFrame:
    """Brings equal symbols together in one shuffle; many contents of one symbol stay spread out."""
    to = F.when(F.col("kind") == SPREAD, F.col("h")).otherwise(F.col("s"))
    return rows.repartition(to).sortWithinPartitions("s", "h", "doc", "at").mapInArrow(_settle(keep_open), MET)


def _spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, size = WordHasher(lower=False), [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for a, b in _slices(texts):
                text, first, n, symbol, content = represent(*hasher(texts[a:b]), window)
                parts.append((symbol.view(np.int64), content.view(np.int64), ids[a + text], _at(tags[a + text], first, n)))
                size += len(text)
            if size > 2_000_000:
                yield _combine(*map(np.concatenate, zip(*parts, strict=True)), spread=True)
                parts, size = [], 0
        if size:
            yield _combine(*map(np.concatenate, zip(*parts, strict=True)), spread=True)
    return run


def _own(covers: pa.Scalar, tag: int, *more: str) -> tuple[np.ndarray, ...]:
    """(first, n, further fields) of the listed stretches that belong to this text."""
    items = covers.values
    at = (items.field("at") if more else items).to_numpy()
    own = (at >> 40) == tag
    at = at[own]
    return (at >> 10) & ((1 << 30) - 1), at & 1023, *(items.field(c).to_numpy()[own] for c in more)


def _windows(window: int):
    """Every window of the asked spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, size = WordHasher(lower=False), [], 0
        for batch in batches:
            for doc, tag, text, spans in zip(*(batch.column(c) for c in ("doc", "tag", "text", "spans")), strict=True):
                first, n, s = _own(spans, tag.as_py(), "s")
                words, _ = hasher([text.as_py()])
                power = WordPowers.of(len(words) + 1)
                sums = np.zeros(len(words) + 1, dtype=U)
                np.cumsum(words * power.up[: len(words)], out=sums[1:], dtype=U)
                s, i = np.repeat(s, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                w = mix((sums[i + window] - sums[i]) * power.down[i]) ^ s.view(U)
                parts.append((mix(w).view(np.int64), s, np.full(len(i), doc.as_py()), _at(np.full(len(i), tag.as_py()), i, np.ones(len(i), dtype=np.int64))))
                size += len(i)
            if size > 2_000_000:
                yield _combine(*map(np.concatenate, zip(*parts, strict=True)), spread=False)
                parts, size = [], 0
        if size:
            yield _combine(*map(np.concatenate, zip(*parts, strict=True)), spread=False)
    return run


def _cut(window: int):
    """n_words, n_removed and the kept words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, tag, covers in zip(*(batch.column(c) for c in ("text", "tag", "covers")), strict=True):
                text = text.as_py()
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                first, n = _own(covers, tag.as_py()) if covers.is_valid else ((), ())
                if len(first):
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + n + window - 1, -1)
                    stay = np.cumsum(step)[:-1] == 0
                    gone.append(len(words) - int(stay.sum()))
                    words = [words[i] for i in np.flatnonzero(stay)]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("hash"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "tag", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, tag, n_words, n_removed, kept), one row per input row; tag is xxhash64 of the text.

    ``kept`` joins the words that stay by one space.
    """
    spark = docs.sparkSession
    if not 0 < window <= MOST_WINDOW:
        raise ValueError(f"window must be from 1 to {MOST_WINDOW}")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    texts = texts.withColumn("tag", F.col("hash").bitwiseAND(F.lit((1 << 23) - 1)))
    folder = scratch_path(spark, f"repeats-{uuid.uuid4().hex[:8]}")
    rows = "kind int, s long, h long, doc long, at long"
    known = texts.where("doc is not null and text is not null").select("doc", "tag", "text")
    _met(known.mapInArrow(_spans(window), rows), keep_open=True).write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    asked = spans.where(F.col("kind") == SPAN).groupBy("doc").agg(F.collect_list(F.struct("s", "at")).alias("spans"))
    single = known.join(asked, "doc").select("doc", "tag", "text", "spans").mapInArrow(_windows(window), rows)
    _met(single, keep_open=False).write.parquet(f"{folder}/windows")
    gone = spans.where(F.col("kind") == GONE).select("doc", "at").union(spark.read.parquet(f"{folder}/windows").select("doc", "at"))
    covers = gone.groupBy("doc").agg(F.collect_list("at").alias("covers"))
    return (texts.join(covers, "doc", "left").select("doc", "hash", "tag", "text", "covers")
            .mapInArrow(_cut(window), "doc_id long, tag long, n_words long, n_removed long, kept string"))
