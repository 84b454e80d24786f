import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gleanboard.operators.passes import PRESCREEN, ModelStopped
from gleanboard.plans.stored_pass import BUCKET_ROWS, WAVE_BUCKETS, RunStore, _waves, stored_pass
from gleanboard.sources import tables

ROWS = 60
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models of this file travel to the workers


@pytest.fixture
def rows(spark):
    return spark.range(ROWS).select(F.lit("p").alias("profile_id"), F.concat(F.lit("k"), "id").alias("key"),
                                    F.concat(F.lit("m"), "id").alias("message"))


def number(message):
    return int(re.sub("[^0-9]", "", message))


def answer(messages):
    if any(number(m) % 10 == 7 for m in messages):
        raise TimeoutError("late")
    return ['{"decision": "pass", "prescreen_notes": "%s"}' % m for m in messages]


def counting(spark, model=answer):
    asked = spark.sparkContext.accumulator(0)

    def model_(messages):
        out = model(messages)
        asked.add(len(messages))
        return out
    return asked, model_


def stored(spark, path, run="one"):
    return {r["key"]: r["error"] for r in tables.read_verdicts(spark, path, run).collect()}


def test_a_pass_is_committed_bucket_by_bucket(spark, rows, tmp_path):
    store = RunStore(str(tmp_path / "v"), "one", bucket_rows=10)
    out = stored_pass(rows, answer, PRESCREEN, store)
    assert out.count() == ROWS and out.where("error is not null").count() == 6
    notes = tables.read_progress(spark, store.path, "one").where("bucket >= 0").collect()
    assert {r["buckets"] for r in notes} == {6} and sum(r["rows"] for r in notes) == ROWS and sum(r["failed"] for r in notes) == 6
    parts = sorted(p.name for p in (tmp_path / "v" / "run_id=one" / "pass=prescreen").iterdir() if p.is_dir())
    assert parts == sorted(f"bucket={r['bucket']}" for r in notes)


def test_a_dead_model_loses_one_bucket_and_nothing_is_asked_twice(spark, rows, tmp_path):
    store = RunStore(str(tmp_path / "v"), "one", bucket_rows=6)

    def dying(messages):
        if any(number(m) == 31 for m in messages):
            raise ModelStopped("quota used up")
        return answer(messages)

    with pytest.raises(PythonException, match="quota used up"):
        stored_pass(rows, dying, PRESCREEN, store)
    before = stored(spark, store.path)
    finished = tables.read_progress(spark, store.path, "one").where("bucket >= 0").count()
    assert 0 < finished < 10 and 0 < len(before) < ROWS
    good = {k for k, e in before.items() if e is None}

    asked, model = counting(spark, lambda ms: ['{"decision": "reject"}' for _ in ms])
    out = stored_pass(rows, model, PRESCREEN, store)
    assert asked.value == ROWS - len(good)
    decisions = {r["key"]: r["decision"] for r in out.collect()}
    assert decisions == {f"k{i}": "pass" if f"k{i}" in good else "reject" for i in range(ROWS)}

    asked, model = counting(spark)  # a finished run has nothing to ask
    assert stored_pass(rows, model, PRESCREEN, store).count() == ROWS and asked.value == 0


def test_another_run_resumes_what_a_broken_one_stored(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    stored_pass(rows.where("key < 'k3'"), answer, PRESCREEN, RunStore(path, "one", bucket_rows=7))
    good = sum(e is None for e in stored(spark, path).values())
    asked, model = counting(spark, lambda ms: ['{"decision": "pass"}' for _ in ms])
    out = stored_pass(rows, model, PRESCREEN, RunStore(path, "two", bucket_rows=25), resume="one")
    assert out.count() == ROWS and asked.value == ROWS - good
    assert len(stored(spark, path, "two")) == ROWS and len(stored(spark, path)) == rows.where("key < 'k3'").count()


def test_rows_that_come_and_go_between_attempts(spark, rows, tmp_path):
    store = RunStore(str(tmp_path / "v"), "one", bucket_rows=9)
    stored_pass(rows.where("key <> 'k5'"), answer, PRESCREEN, store)
    assert stored_pass(rows.where("key <> 'k8'"), answer, PRESCREEN, store).count() == ROWS - 1
    assert stored_pass(rows.limit(0), answer, PRESCREEN, store).count() == 0
    assert stored_pass(rows.limit(0), answer, PRESCREEN, RunStore(str(tmp_path / "none"), "x")).count() == 0


def test_small_buckets_are_committed_in_waves_and_large_ones_alone(spark, rows, tmp_path):
    store = RunStore(str(tmp_path / "v"), "one", bucket_rows=1)
    assert stored_pass(rows, answer, PRESCREEN, store, concurrency=2).count() == ROWS
    notes = tables.read_progress(spark, store.path, "one").where("bucket >= 0").collect()
    assert {r["buckets"] for r in notes} == {ROWS} and sum(r["rows"] for r in notes) == ROWS and sum(r["failed"] for r in notes) == 6
    stored_rows = {r["bucket"]: r["n"] for r in spark.read.parquet(store.path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert stored_rows == {r["bucket"]: r["rows"] for r in notes}
    commits = len(list((tmp_path / "v" / "_progress").glob("*.parquet")))
    assert commits <= 7  # the number of buckets, and waves of 1, 2, 4, 8, 16 and the rest
    sizes = [[{"rows": n}] * 3 for n in (BUCKET_ROWS, BUCKET_ROWS // 2, 1)]
    assert [[len(w) for w in _waves(s)] for s in sizes] == [[1, 1, 1], [1, 2], [1, 2]]
    assert max(len(w) for w in _waves([{"rows": 150}] * 1_000)) == WAVE_BUCKETS
