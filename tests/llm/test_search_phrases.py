"""Bit-sliced search, collocations and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanboard.llm import bit_sliced, collocations, importance

VECTORS = "vec_id long, embedding array<double>, rank string, score string, q int"


# -- bit-sliced index ----------------------------------------------------------

def test_slices_add_compare_and_select_like_numbers():
    rng = np.random.default_rng(5)
    for rows, dims in ((1, 1), (70, 5), (200, 9)):
        values = rng.integers(-300, 300, size=(rows, dims))
        query = rng.integers(-40, 40, size=dims)
        shift, bits, low, slices = bit_sliced.slice_block(values, kept=4)
        kept = (values - low) >> shift
        both = np.concatenate([slices, ~slices], axis=1)
        total = bit_sliced.weighted_sum(both, query)
        want = (np.abs(query) * np.where(query < 0, (1 << bits) - 1 - kept, kept)).sum(axis=1)
        every = bit_sliced.bitmap(np.ones(rows, dtype=bool))
        planes = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, :rows].astype(np.int64)
        assert (sum(plane << i for i, plane in enumerate(planes)) == want).all()
        for k in (1, rows // 2 + 1, rows):
            assert bit_sliced.greatest(total, every, k) == sorted(want, reverse=True)[k - 1]
        for least in (-3, 0, 1, int(want.mean()), int(want.max()), int(want.max()) + 1, 1 << 40):
            assert bit_sliced.rows_of(bit_sliced.at_least(total, every, least)).tolist() == np.flatnonzero(want >= least).tolist()


def vectors(seed=1, n=300, dim=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim) / math.sqrt(dim)
        rows.append((i, np.round(v, 2).tolist()))
    rows += [(1000 + i, rows[20][1]) for i in range(80)]                 # a great tie
    rows += [(2000 + i, [0.0] * dim) for i in range(3)]
    rows += [(3000, None), (3010, [None] + [1.0] * (dim - 1)), (3020, [math.nan] * dim), (3030, [math.inf] * dim)]
    rows += [(3040, []), (3041, []), (3050, [0.5, 0.25]), (3051, [0.125, -0.3])]  # other lengths
    rows += [(10, rows[10][1]), (None, rows[20][1]), (None, rows[3][1])]  # a repeated row, rows without an id
    random.Random(seed).shuffle(rows)
    return rows


def brute_top(rows, k, every):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q is None or q % every:
            continue
        found = [(-max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -2**63), i is None, i or 0)
                 for i, b in usable if len(a) == len(b) and i != q]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS).repartition(3)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,batch_bytes,k", [(64, 1 << 20, 10), (64, 400, 3), (4096, 1 << 20, 1), (128, 1 << 20, 500)])
def test_top_k_is_exact(spark, block, batch_bytes, k):
    rows = vectors()
    got = bit_sliced.top_k(table_of(spark, rows), F.col("vec_id") % 10 == 0, k, block=block, batch_bytes=batch_bytes)
    assert found(got) == brute_top(rows, k, 10)


def test_great_numbers_and_long_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(-3, 200) for _ in range(4)]) for i in range(40)]
    assert found(bit_sliced.top_k(table_of(spark, rows), F.col("vec_id") % 4 == 0, 5)) == brute_top(rows, 5, 4)
    rows = [(i, [rng.uniform(-9, 9) for _ in range(3000)]) for i in range(30)]
    assert found(bit_sliced.top_k(table_of(spark, rows), F.col("vec_id") % 4 == 0, 5)) == brute_top(rows, 5, 4)


def test_no_vectors_and_no_queries(spark):
    rows = vectors(n=30)
    assert bit_sliced.top_k(table_of(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert bit_sliced.top_k(table_of(spark, rows), F.lit(None).cast("boolean")).count() == 0


# -- collocations --------------------------------------------------------------

def texts(seed=4, n=60):
    rng = random.Random(seed)
    words = ["a", "ab", "été", "the", "New", "york", "x\x1cy", "\U0001d11e", "city"]
    fixed = "new york city hall of the old town and so on for ever"
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            part = [rng.choice(words) for _ in range(rng.randint(0, 30))]
            part += (fixed.split() if rng.random() < 0.5 else []) + [rng.choice(words)]
            parts.append(rng.choice([" ", "\t", "  "]).join(part))
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([". ", ",", "!?", "\n", "\x0b"]).join(parts)))
    out += [("en", None), ("en", ""), ("en", " . ,\t"), (None, None), ("lo", "one two " * 3000), ("lo", "z " * 700)]
    return out + [out[0]] * 3


def brute_phrases(rows, least, longest, covered, kept):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(best)[:kept])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,covered,kept,trigger",
                         [(20, 5, 100, 2000, 16), (5, 5, 100, 7, 2), (5, 3, 60, 2000, 5), (3, 2, 100, 2000, 3), (9, 5, 30, 2000, 10**6)])
def test_phrases_are_counted_exactly(spark, least, longest, covered, kept, trigger):
    rows = texts()
    docs = spark.createDataFrame([(lang, t, "s", 1, 2) for lang, t in rows], "lang string, text string, phrase string, n int, a int").repartition(3)
    got = collocations.collocations(docs, longest=longest, least=least, kept=kept, covered=covered, trigger=trigger)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, longest, covered, kept)


def test_every_start_is_owned_once_and_equal_passages_share_chunks():
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(400)]
    texts = [" ".join([f"{side}{rng.getrandbits(40)}" for _ in range(rng.randint(1, 60))] + passage) for side in "abcd"]
    parser = collocations.Parser()
    chunks = [parser([t])[0] for t in texts]
    for text, cut in zip(texts, chunks, strict=True):
        words = text.split()
        at = 0
        for chunk, own in cut:
            got = chunk.decode().split()
            assert got == words[at: at + len(got)] and (len(got) >= own + 4 or at + len(got) == len(words))
            at += own
        assert at == len(words)
    shared = set(chunks[0]) & set(chunks[1]) & set(chunks[2]) & set(chunks[3])
    assert sum(own for _, own in shared) > 250


def test_scores_beyond_64_bits_stay_exact(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "a b")], "lang string, text string")
    big = 4_000_000_000_000
    one = collocations.Counter
    monkeypatch.setattr(collocations, "HELD_ROWS", 1)

    class Repeated(one):
        """Every chunk and word as if the text stood there very often."""
        def values(self):
            return [big] * len(self)

    monkeypatch.setattr(collocations, "Counter", Repeated)
    got = collocations.collocations(rows).first()
    assert (got["a"], got["n"], got["score"]) == (big, 2 * big, 1000 * big * 2 * big // (big * big))


def test_rare_phrases_of_frequent_parts_make_no_rows(spark, monkeypatch):
    """Twenty words in any order: all pairs occur often, hardly a triple does."""
    rng, made, by_slices = random.Random(7), [], collocations._by_slices
    rows = [("en", " ".join(f"w{rng.randrange(20)}" for _ in range(100)) + ". so it is") for _ in range(300)]

    def noted(chunks, rows_of, schema, *more):
        made.append((schema, by_slices(chunks, rows_of, schema, *more)))
        return made[-1][1]

    monkeypatch.setattr(collocations, "_by_slices", noted)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4), least=30)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 30, 5, 100, 2000)
    pairs, triples, *_ = (df.count() for schema, df in made if "phrase" in schema)
    assert pairs > 400 and triples < 100  # of 8,000 triples


def test_a_task_hands_on_a_long_phrase_once(spark, monkeypatch):
    """However many slices a task has; fewer rows held change no count."""
    made, by_slices, batch = [], collocations._by_slices, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1)
    monkeypatch.setattr(collocations, "_by_slices", lambda *a: made.append((a[2], by_slices(*a))) or made[-1][1])
    rng = random.Random(3)
    rows = [("en", " ".join(f"w{rng.randrange(4)}" for _ in range(30))) for _ in range(90)] + [("de", "eins zwei drei. vier")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    try:
        for held in (300_000, 1):
            monkeypatch.setattr(collocations, "HELD_ROWS", held)
            got = collocations.collocations(docs, trigger=10**6, least=20)
            assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 20, 5, 100, 2000)
            triples = [df for schema, df in made if "phrase" in schema][1].where("lang = 'en'")
            repeated = triples.groupBy(F.spark_partition_id(), "phrase").count().where("count > 1").count()
            assert (repeated == 0) == (held > 1)
            made.clear()
    finally:
        spark.conf.set(batch, before)


@pytest.mark.parametrize("least", [300, 70_000])
def test_buckets_hold_counts_of_any_size(spark, least):
    rows = [("en", "a b c " * 200)] * (least // 199) + [("de", "a b c " * 100)] * 2 + [("en", "b d")] * 299
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=least)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, 5, 100, 2000)


def test_more_words_than_buckets_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BUCKETS", 1 << 11)
    monkeypatch.setattr(collocations, "MOST_BUCKET_BYTES", 1 << 11)
    rows = texts(8)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=9)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 9, 5, 100, 2000)


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# -- importance resampling -----------------------------------------------------

def brute_resample(rows, target, percent, least, buckets, longest):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [zlib.crc32(" ".join(w[i: i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    made = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + float(buckets)) / ((s[b] + 1.0) * (n_t + float(buckets))))) for b in range(buckets)]
    out = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = [(*r, k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    rest = Counter(out) - Counter(r[:5] for r in drawn)
    return sorted(drawn + [(*r, None) for r in rest.elements()], key=str)


@pytest.mark.parametrize("longest,buckets,slice_bytes", [(1, 10_000, 2_000_000), (2, 97, 50), (3, 10_000, 2_000_000)])
def test_draws_equal_brute_force(spark, monkeypatch, longest, buckets, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    rng = random.Random(longest)
    words = ["Alpha", "beta", "x1", "été", "ß q", "\U0001d11e", "42", "A"]
    rows = [(i, " ,-"[i % 3].join(rng.choice(words) for _ in range(rng.randint(0, 45)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "!?"), (503, "word " * 5000), (None, rows[3][1] + " one" * 20), rows[7], rows[7]]
    target = ["alpha 42 42", None, "", "beta-x1"]
    docs = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, weight int, bucket string, place int").repartition(3)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = importance.resample(docs, bench, buckets=buckets, longest=longest, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, target, 30, 20, buckets, longest)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.resample(none, docs).count() == 0
    rows = importance.resample(docs, none, percent=50).collect()
    assert len(rows) == 2 and [r["rank"] for r in rows if r["rank"]] == [1]
