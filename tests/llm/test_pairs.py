"""Jaccard join, substring dedup and embedding dedup against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanboard.llm import embedding_dedup, graph, jaccard_join, substring_dedup
from gleanboard.llm.words import WordHasher, shingle_sets

DOCS = "doc_id long, text string, component_id string, node int, n int"


def corpus(seed=3, n=60):
    """Texts with near copies at many distances, shared passages, tiny ones, runs, nulls and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 30, 90, 300]))]
        if rng.random() < 0.5:
            base[len(base) // 2: len(base) // 2] = passage[: rng.choice([49, 50, 51, 70])]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" \t".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    texts += ["", None, "  \n", "a", "A", "the " * 400, "the " * 120 + "end", "x y " * 200, "x y " * 90, "é\x1cß ünï " * 30]
    rng.shuffle(texts)
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[0], "x", 1, 2), (None, None, "x", 1, 2)]


def ascii_words(text, lower):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingle_set(text):
    w = ascii_words(text, True)
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, share_pct=80):
    sets = [shingle_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share_pct * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted((str(r[0]), len(s), str(least.get(c))) for r, s, c in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_groups(spark, seed):
    rows = corpus(seed)
    got, links = jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == brute_components(rows)
    assert links.columns == ["a", "b"]


@pytest.mark.parametrize("share_pct", [30, 50, 95])
def test_other_shares(spark, share_pct):
    """Texts of one beginning and many lengths, so that similar sets lie in bands far apart."""
    rng = random.Random(share_pct)
    rows = []
    for i in range(12):
        base = [f"w{rng.getrandbits(30)}" for _ in range(200)]
        rows += [(100 * i + k, " ".join(base[: n]), "x", 1, 2) for k, n in enumerate((200, 180, 110, 70, 40, 25, 17, 9))]
    got, _ = jaccard_join.jaccard_groups(spark.createDataFrame(rows, DOCS), share_pct=share_pct)
    want = brute_components(rows, share_pct)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == want


def test_representatives_are_one_row_of_a_group(spark):
    rows = corpus(8, 25)
    rows += [rows[2], rows[2], (rows[4][0], rows[2][1], "x", 1, 2), (None, rows[6][1], "x", 1, 2), (None, None, "y", 1, 2)]
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in jaccard_join.representatives(df.repartition(3)).collect()]
    groups, _ = jaccard_join.jaccard_groups(df)
    of = {r["h"]: r["component"] for r in groups.collect()}
    h = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", jaccard_join.row_hash().alias("h")).collect()}
    members = {}
    for r in set(rows):
        members.setdefault(of[h[r[:2]]] if of[h[r[:2]]] is not None else ("alone", r[:2]), set()).add(r[:2])
    assert len(got) == len(members)  # one row of each group, a repeated row once
    for group in members.values():
        kept = [r[:2] for r in got if r[:2] in group]
        assert len(kept) == 1 and (kept[0][0] is None) == all(i is None for i, _ in group)
        assert kept[0][0] is None or kept[0][0] == min(i for i, _ in group if i is not None)


def test_frequent_shingles_survive_folding(monkeypatch):
    monkeypatch.setattr(jaccard_join.Frequent, "HELD", 50)
    often, rng = jaccard_join.Frequent(), np.random.default_rng(1)
    for _ in range(3_000):
        often.add(np.unique(np.append(rng.integers(0, 2**60, 20), [7, 9]).astype(np.uint64)))
    keys, counts = often.fold()
    assert {7, 9} <= set(keys.tolist()) and counts[keys == 7][0] == 3_000 and len(keys) < 300


def test_open_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rows = spark.range(103).selectExpr("if(id < 100, 1L, 2L) AS key", "id AS node", "id AS component", "5L AS n", "X'00' AS sketch", "array(1L) AS keys")
    cells, met = {}, []
    for r in jaccard_join._cells(rows).collect():
        cells.setdefault((r["key"], r["lo"], r["hi"]), []).append((r["node"], r["part"]))
    for (_, lo, hi), members in cells.items():
        assert len(members) < 50
        met += [(min(a, b), max(a, b)) for a, p in members for b, q in members if a < b and (lo == hi or p != q)]
    assert sorted(met) == [(a, b) for a in range(103) for b in range(a + 1, 103) if (a < 100) == (b < 100)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    docs = corpus(6)
    got, _ = jaccard_join.jaccard_groups(spark.createDataFrame(docs, DOCS))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == brute_components(docs)


def test_keys_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    for common_share in (0.0, 0.3, 0.95):
        for n in (1, 4, 5, 6, 9, 16, 25, 26, 40, 41, 120, 700, 3000):
            for _ in range(12):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                extra = rng.integers(0, n // 4 + 1)
                lost = rng.integers(0, n // 4 + 1)
                b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, extra).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 80 * (len(a) + len(b) - both):
                    continue
                common = np.sort(a[rng.random(len(a)) < common_share])
                keys = jaccard_join.Keys(0.8, common)
                assert np.intersect1d(keys(a), keys(b)).size, (n, extra, lost)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (5, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 3:], rng.integers(0, 2**63, n * 2).astype(np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.sketch(s), dtype=np.uint64) for s in (a, b))
        assert jaccard_join.distance(x, y) <= len(np.setxor1d(a, b))
        assert jaccard_join.distance(x, x) == 0


def test_shingle_sets_match_words():
    texts = ["A b c d e F", None, "", "one", "a b c d e f a b c d e f", "é É"]
    sets = list(shingle_sets(*WordHasher(lower=True)(texts), 5))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]


def brute_repeats(rows, window=50):
    words = [ascii_words(t, False) for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k: k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 5])
def test_remove_repeats(spark, seed):
    rows = corpus(seed) + [(7, "another text under an id that exists " * 20, "x", 1, 2)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


@pytest.mark.parametrize("window", [20, 64, 100, 200])
def test_other_windows(spark, window):
    rng = random.Random(window)
    some = lambda n: [f"w{rng.getrandbits(20)}" for _ in range(n)]
    passages = [some(n) for n in (window, 2 * window, 3 * window + 7)] + [["run"] * (3 * window)]
    rows = []
    for i in range(40):
        words = [w for _ in range(3) for w in some(rng.randint(0, window)) + rng.choice(passages)]
        rows.append((i, " ".join(words), "x", 1, 2))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), window=window).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows, window)


def test_windows_beyond_a_span_are_refused(spark):
    with pytest.raises(ValueError, match="window"):
        substring_dedup.remove_repeats(spark.createDataFrame([], DOCS), window=5_000)


def test_passage_twice_in_one_document(spark):
    rng = random.Random(11)
    some = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(n))
    rows = []
    for k in range(0, 80, 4):
        passage, x, y, z = some(55), some(60), some(60), some(60)
        rows += [(k, f"{some(60)} {passage} {some(60)}", "x", 1, 2), (k + 1, f"{x} {passage} {y} {x} {passage} {y}", "x", 1, 2),
                 (k + 2, f"{x} {passage} {y} {z}", "x", 1, 2), (k + 2, f"{z} {x} {passage} {y}", "x", 1, 2),
                 (k + 3, f"{z} {passage} {y}", "x", 1, 2), (k + 3, f"{z} {passage} {y}", "x", 1, 2)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 30, 120).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    around = [rng.integers(0, 30, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (3, 77, 20)]
    found = []
    for before, after in ((around[0], around[1]), (around[1], around[2])):
        words = np.concatenate([before, passage, after])
        text, first, n, symbol, _ = substring_dedup.represent(words, np.array([0, len(words)]), 50)
        by_window = dict(zip(np.concatenate([np.arange(f, f + k) for f, k in zip(first, n, strict=True)]).tolist(),
                             np.repeat(symbol, n).tolist(), strict=True))
        found.append([by_window[len(before) + k] for k in range(120 - 49)])
    assert found[0] == found[1]


def brute_vectors(rows):
    good = [i for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and r[1]
            and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    x, y = label[i], label[j]
                    label = [y if c == x else c for c in label]
    least = {}
    for r, c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, r[0]), r[0])
    return sorted((r[0], n, least[c], r[0] == least[c]) for r, n, c in zip(rows, links, label, strict=True))


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 30)):
            rows.append([len(rows), [float(np.float32(x)) for x in base + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.25])], k % 3])
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 5, [1.0] * 5, [2.0], [3.0]]
    rows += [[len(rows) + i, v, 0] for i, v in enumerate(bad)]
    rows += [[len(rows), rows[0][1], None], [len(rows) + 1, rows[0][1], rows[0][2]]]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)  # so that blocks are cut
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, filters string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == brute_vectors(rows)


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).union(spark.sql("SELECT 100L, 101L")).union(
        spark.sql("SELECT 5L, CAST(NULL AS LONG)"))
    got = {r["node"]: r["component"] for r in graph.components(links, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard_join.jaccard_groups(docs)[0].count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0
