import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanboard.operators import nearest


def tables(spark, n, q, copies=0, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[:copies] = vectors[0]
    index = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None)],
                                  "key string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(vectors[:q])],
                                    "query_id string, embedding array<float>")
    return index, queries, vectors.astype(np.float32).astype(np.float64)


def brute_force(vectors, q, k):
    out = set()
    for i in range(q):
        scores = np.round(vectors @ vectors[i], 6)
        ranked = sorted(range(len(vectors)), key=lambda j: (-scores[j], f"k{j}"))[:k]
        out |= {(f"q{i}", r + 1, f"k{j}", round(float(scores[j]), 6)) for r, j in enumerate(ranked)}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["key"], round(r["score"], 6)) for r in df.collect()}


@pytest.mark.parametrize("copies", [0, 200])
@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_search_is_exact_also_among_copies(spark, copies, block_bytes):
    index, queries, vectors = tables(spark, 400, 12, copies)
    assert found(nearest.search(index, queries, 9, block_bytes=block_bytes)) == brute_force(vectors, 12, 9)


def test_small_tiles_and_buffers_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 50)
    index, queries, vectors = tables(spark, 300, 5, 40)
    assert found(nearest.search(index, queries, 6)) == brute_force(vectors, 5, 6)


def test_k_above_the_corpus_and_empty_sides(spark):
    index, queries, _ = tables(spark, 5, 2)
    assert nearest.search(index, queries, 50).count() == 10
    assert nearest.search(index.limit(0), queries, 5).count() == 0
    assert nearest.search(index, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 25, 1, 500])
def test_blocks_with_repeated_and_numeric_ids(spark, block_bytes):
    """A query id that repeats asks with all its vectors; ids and keys keep their types."""
    index, queries, vectors = tables(spark, 60, 6)
    index = index.where("key <> 'none'").withColumn("key", F.substring("key", 2, 9).cast("long"))
    asked = queries.withColumn("query_id", (F.substring("query_id", 2, 9).cast("int") / 2).cast("int"))
    got = nearest.search(index, asked, 4, block_bytes=block_bytes)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "bigint", "double"]
    for q in range(3):
        both = np.round(vectors @ vectors[[2 * q, 2 * q + 1]].T, 12)
        pairs = sorted(((-s, j) for j, row in enumerate(both) for s in row))[:4]
        rows = sorted((r["rank"], r["key"]) for r in got.where(f"query_id = {q}").collect())
        assert [k for _, k in rows] == [j for _, j in pairs]


def test_columns_of_the_index_come_with_the_hits(spark):
    index, queries, vectors = tables(spark, 50, 3)
    carried = index.withColumn("metadata", F.create_map(F.lit("key"), "key")).withColumn("n", F.length("key"))
    plain = found(nearest.search(index, queries, 4))
    rows = nearest.search(carried, queries, 4, columns=("metadata", "n")).collect()
    assert {(r["query_id"], r["rank"], r["key"], round(r["score"], 6)) for r in rows} == plain
    assert all(r["metadata"] == {"key": r["key"]} and r["n"] == len(r["key"]) for r in rows)


def test_vectors_of_different_lengths_are_refused(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], "key string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    with pytest.raises(Exception, match="different lengths"):
        nearest.search(index.coalesce(1), queries, 1).collect()


def test_one_query_equals_many(spark):
    index, queries, _ = tables(spark, 100, 1, 10)
    one = nearest.search_one(index, queries.first()["embedding"], 20).collect()
    many = nearest.search(index, queries, 20).orderBy("rank").collect()
    assert [(r["key"], round(r["score"], 6)) for r in one] == [(r["key"], round(r["score"], 6)) for r in many]


def test_small_blocks_share_a_scan_of_the_index(spark, monkeypatch):
    rng, scans, scan = np.random.default_rng(5), [], nearest._scan
    vectors = np.repeat(rng.normal(size=(150, 6)) * np.array([1e4, 1.0] * 75)[:, None], 2, axis=0)  # ties, and scores of any size
    index = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(vectors)], "key string, embedding array<double>").repartition(3)
    queries = index.select(F.col("key").alias("query_id"), "embedding")
    monkeypatch.setattr(nearest, "_scan", lambda *a: scans.append(1) or scan(*a))
    got = sorted(map(tuple, nearest.search(index, queries, 4, block_bytes=2_000).collect()))
    assert len(scans) == 1
    monkeypatch.setattr(nearest, "QUERY_BLOCK_BYTES", 6_000)
    assert got == sorted(map(tuple, nearest.search(index, queries, 4, block_bytes=2_000).collect())) and len(scans) > 5
    scores = np.round(vectors @ vectors.T, 12)
    for i in (0, 1, 2, 151):
        best = sorted((-scores[i, j], f"k{j}") for j in range(300))[:4]
        assert [k for q, _, k, _ in sorted(got, key=lambda r: r[1]) if q == f"k{i}"] == [k for _, k in best]


def test_texts_reach_the_embedder_in_bounded_batches(spark):
    from gleanboard.plans import index as indexing
    from gleanboard.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)

    def embedder(texts):
        if len(texts) > 3 or "bad" in texts:
            raise ValueError("too many or bad")
        return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    rows = [(i, t, {"a": str(i)}) for i, t in enumerate(["x", "bad", "yy", "zzz", "", "w"] * 3)]
    out = indexing.with_embedding(spark.createDataFrame(rows, "i int, t string, m map<string,string>"), "t", embedder, batch=3)
    assert int(spark.conf.get(key)) == BATCH_BYTES
    for i, t, m, v in out.collect():
        assert (i, t, m) == rows[i] and (v is None if t == "bad" else np.allclose(v, [0.6, 0.8] if t else [0, 0]))
