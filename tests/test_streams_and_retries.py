import datetime as dt
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanboard.operators import bitmaps, nearest
from gleanboard.operators.dedupe import merge_across_sources
from gleanboard.plans import index as indexing
from gleanboard.plans.collect import ingest
from gleanboard.sources import tables
from gleanboard.streaming.first_wins import ProvenanceLog
from gleanboard.streaming.incremental_index import index_stream, stored_for
from test_dedupe import SCHEMA, random_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])
POSTING = "key string, title string, employer_name string, city string, description string"


def postings(spark, numbers):
    return spark.createDataFrame([(f"k{i}", f"t{i}", "Acme", "Ulm", "d") for i in numbers], POSTING)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_reader_takes_the_last_generation_and_what_came_after(spark, tmp_path):
    df = spark.createDataFrame(random_rows(140, 5) + [(900, "Acme", "Dev", None, "u", "A", "z")] * 3, SCHEMA)
    landing, log = tmp_path / "in", ProvenanceLog(str(tmp_path / "log"), ["n"], compact_every=3)
    for part in range(7):
        df.where(F.col("n") % 7 == part).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(df.schema).parquet(str(landing))
        log.start(stream, str(tmp_path / "marks")).awaitTermination()
    wanted = sorted((r["n"], tuple(r["found_on"])) for r in merge_across_sources(df, ["n"]).collect())
    rows = lambda: sorted((r["n"], tuple(r["found_on"])) for r in log.read(spark).collect())
    assert rows() == wanted
    upto, folder = log.generation(spark)
    assert upto == 5
    files = [r["f"] for r in log.groups(spark, upto, folder).select(F.input_file_name().alias("f")).distinct().collect()]
    assert all("batch_id=6" in f or folder in f for f in files) and any(folder in f for f in files)
    log.compact(spark, 5)  # noted twice: the content is the same
    assert log.generation(spark)[1] != folder and rows() == wanted


def test_a_build_that_is_repeated_stores_nothing_twice(spark, tmp_path):
    path, embedder = str(tmp_path / "index"), indexing.hashing_embedder(8)
    for _ in range(2):
        index, _, _ = indexing.build_index(postings(spark, range(30)), path, embedder, "m", build="monday")
    assert index.count() == 30 and index.select("key").distinct().count() == 30
    index, _, _ = indexing.build_index(postings(spark, range(40)), path, embedder, "m")
    assert index.count() == 40 and set(index.columns) == {"key", "model", "embedding", "document", "metadata"}
    with pytest.raises(ValueError, match="duplicate keys"):
        indexing.build_index(postings(spark, [1, 1]), path, embedder, "m", unique_keys=True)


def test_a_micro_batch_reads_its_key_buckets_only(spark, tmp_path):
    path, calls = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    base = indexing.hashing_embedder(8)

    def counting(texts):
        calls.add(len(texts))
        return base(texts)

    landing = str(tmp_path / "in")
    for numbers in (range(200), [3, 500], [3, 500, 501]):
        postings(spark, numbers).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(POSTING).parquet(landing)
        index_stream(stream, path, str(tmp_path / "marks"), counting, "m").awaitTermination()
    assert tables.read_embeddings(spark, path, "m").count() == 202 == calls.value
    one = postings(spark, [7]).checkpoint()
    read = stored_for(one, path, "m").select("key", "embedding")
    bucket = one.select(tables.key_bucket().alias("b")).first()["b"]
    scanned = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert scanned and all(f"bucket={bucket}/" in r["f"] for r in scanned)


def test_a_run_registered_again_replaces_itself(spark, tmp_path):
    path, now = str(tmp_path), dt.datetime(2026, 5, 20)
    profiles = spark.createDataFrame([("p", "cv")], "profile_id string, cv_text string")
    for top in (1, 2):
        tables.register_run(spark, path, "r1", now, {"top_n": top}, profiles)
    tables.register_run(spark, path, "r2", now, {"top_n": 3}, profiles)
    rows = {r["run_id"]: r["settings"] for r in tables.recent_runs(spark, path).collect()}
    assert rows == {"r1": '{"top_n": 2}', "r2": '{"top_n": 3}'}
    assert spark.read.parquet(f"{path}/profiles").count() == 2


def test_ingest_counts_in_passing(spark, tmp_path):
    df = spark.createDataFrame(random_rows(90, 1), SCHEMA).withColumn("row_ord", F.lpad(F.col("n").cast("string"), 5, "0")).drop("actor")
    unique, summary = ingest({"x": df.where("n % 3 = 0"), "y": df.where("n % 3 > 0"), "none": df.limit(0)}, str(tmp_path))
    assert {r["label"]: r["rows"] for r in summary.collect()} == {
        "x": 30, "y": 60, "none": 0, "raw total": 90, "unique total": unique.count()}


def test_bitmaps_never_miss_a_key(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bitmap = bitmaps.bitmap_of(keys, 5_000)
    hashes = np.array([r[0] for r in spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).select(bitmaps.key_hash()).collect()])
    found = bitmaps.may_hold(bitmap, hashes)
    assert found[:5_000].all() and found[5_000:].mean() < 0.15


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_a_scope_is_exact_however_it_is_sent(spark, monkeypatch, small_rows):
    monkeypatch.setattr(bitmaps, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(bitmaps, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(bitmaps, "BITS_A_KEY", 1)  # a bitmap that lets many strangers through
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3_000, 6))
    index = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(vectors)], "key string, embedding array<double>").repartition(4)
    queries = index.where("key in ('k1', 'k2')").select(F.col("key").alias("query_id"), "embedding")
    scope = index.where("cast(substring(key, 2, 9) as int) % 3 = 0").select("key", F.lit(1).alias("other"))
    got = nearest.search(index, queries, 5, scope=scope.union(scope.limit(7)), small_rows=small_rows)
    wanted = nearest.search(index.join(scope, "key", "left_semi"), queries, 5)
    assert got.count() == 10 and got.exceptAll(wanted).isEmpty()


def test_a_scope_does_not_move_the_vectors(spark):
    from gleanboard.checks.inputs import doc_postings, label_queries, vector_index
    from gleanboard.checks.registry import Inputs

    t = Inputs(spark, "/root/testdata/sf0.001")
    for small_rows in (0, 10**6):
        text = plan(nearest.search(vector_index(t), label_queries(t), 5, scope=doc_postings(t), small_rows=small_rows))
        moved = [line for line in text.splitlines() if "Exchange" in line and "embedding" in line]
        assert not moved


def test_the_generation_noted_last_is_read(spark, tmp_path):
    df = spark.createDataFrame(random_rows(20, 2) + [(900, "Acme", "Dev", None, "u", "A", "z")] * 3, SCHEMA)
    landing, log = str(tmp_path / "in"), ProvenanceLog(str(tmp_path / "log"), ["n"], compact_every=1)
    df.coalesce(1).write.parquet(landing)
    log.start(spark.readStream.schema(df.schema).parquet(landing), str(tmp_path / "marks")).awaitTermination()
    seen = [log.generation(spark)[1]]
    for _ in range(4):
        log.compact(spark, 0)
        seen.append(log.generation(spark)[1])
    assert len(set(seen)) == 5 and seen == sorted(seen)
    assert log.read(spark).count() == merge_across_sources(df, ["n"]).count()


def test_landed_files_stay_small_and_give_the_same_rows(spark, monkeypatch):
    from gleanboard.checks import jobs
    from gleanboard.checks.registry import QUERIES

    for rows, parts, most in ((216_000_000, 4, jobs.FILE_ROWS), (216_000_000, 8, jobs.FILE_ROWS), (6_200_000, 4, jobs.FILE_TEXTS)):
        assert rows / (parts * jobs.files_a_part(rows, parts, most)) <= most
    assert jobs.files_a_part(6_000, 4) == 1
    got = []
    for files in (1, 3):
        monkeypatch.setattr(jobs, "files_a_part", lambda *_: files)
        got.append({name: sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
                    for name in ("j2_provenance_stream", "j2_generations", "j3_index_stream")})
    assert got[0] == got[1]
