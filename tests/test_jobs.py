import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleanboard.checks import QUERIES
from gleanboard.checks.inputs import doc_postings, vector_index
from gleanboard.checks.jobs import STAND_IN, profiles, recruiter_model
from gleanboard.checks.registry import Inputs
from gleanboard.operators.passes import PRESCREEN, RECRUITER, call_each, score_pass
from gleanboard.plans import index as indexing
from gleanboard.plans.ask import ask
from gleanboard.plans.match import MatchSettings, Models, RunStore, match, rescore
from gleanboard.session import settle
from gleanboard.sources import tables

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 5, 20, 1)


def run(spark, models=STAND_IN, index=None, **options):
    t = Inputs(spark, SF)
    index = vector_index(t).select("key", "embedding") if index is None else index
    return match(profiles(t), doc_postings(t), index, models, now=NOW,
                 settings=MatchSettings(top_n=20), **options)


def test_one_bad_message_does_not_spoil_its_batch():
    def model(messages):
        if "bad" in messages:
            raise ValueError("no")
        return [m.upper() for m in messages]

    assert call_each(model, ["a", "bad", "b"]) == [("A", None), (None, "no"), ("B", None)]
    assert call_each(lambda m: ["x"], ["a", "b"]) == [("x", None), ("x", None)]  # short batch: asked one by one


def test_errors_are_retried_and_good_records_reused(spark):
    rows = spark.createDataFrame([("p", f"k{i}", f"m{i}") for i in range(6)], "profile_id string, key string, message string")

    def flaky(messages):
        if any(m == "m3" for m in messages):
            raise TimeoutError("late")
        return ['{"decision": "pass"}' for _ in messages]

    first = settle(score_pass(rows, flaky, PRESCREEN).drop("cached"))
    assert first.where("error is not null").count() == 1
    again = score_pass(rows, lambda ms: ['{"decision": "reject"}' for _ in ms], PRESCREEN, cache=first)
    assert {r["key"]: r["decision"] for r in again.collect()} == {**{f"k{i}": "pass" for i in range(6)}, "k3": "reject"}


def test_a_reply_cannot_overwrite_the_key(spark):
    rows = spark.createDataFrame([("p", "k", "m")], "profile_id string, key string, message string")
    row = score_pass(rows, lambda m: ['{"key": "stolen", "technical_match": 5}'], RECRUITER).first()
    assert row["key"] == "k" and row["technical_match"] == 5


def test_nobody_survives_gives_an_empty_result(spark):
    reject = Models(lambda ms: ['{"decision": "reject"}'] * len(ms), STAND_IN.recruiter, STAND_IN.candidate)
    assert run(spark, reject).count() == 0
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    assert run(spark, index=empty).count() == 0


def test_a_failing_prescreen_keeps_everything(spark):
    def broken(messages):
        raise ConnectionError("down")

    kept = run(spark, Models(broken, STAND_IN.recruiter, STAND_IN.candidate), prescreen_only=True)
    assert kept.groupBy("profile_id").count().where("count = 20").count() == 10


def test_resume_calls_the_model_only_for_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    fresh = {tuple(r) for r in run(spark, store=RunStore(path, "one")).select("profile_id", "key", "rank").collect()}

    def only_failed(messages):
        # Errored verdicts are asked again; anything else must come from the cache.
        assert all(int(m.split("Title: Posting ")[1].split("\n")[0]) % 37 < 3 for m in messages), "asked twice"
        raise TimeoutError("still no answer")

    resumed = run(spark, Models(only_failed, only_failed, only_failed), store=RunStore(path, "two", resume="one"))
    assert {tuple(r) for r in resumed.select("profile_id", "key", "rank").collect()} == fresh
    errors = {r["error"].split("': ")[1] for r in tables.read_verdicts(spark, path, "two").where("error is not null").collect()}
    assert errors <= {"still no answer"}


def test_rescoring_with_the_stored_weights_changes_nothing(spark):
    from gleanboard.functions.scores import CANDIDATE_WEIGHTS, RECRUITER_WEIGHTS

    result = run(spark)
    again = rescore(result, RECRUITER_WEIGHTS, CANDIDATE_WEIGHTS)
    assert again.select(*result.columns).exceptAll(result).isEmpty()


def test_index_embeds_each_key_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    base = indexing.hashing_embedder(16)

    def counting(texts):
        calls.add(len(texts))
        return base(texts)

    postings = spark.createDataFrame([(f"k{i}", f"t{i}", None, "Ulm", "d") for i in range(10)],
                                     "key string, title string, employer_name string, city string, description string")
    path = str(tmp_path / "index")
    indexing.build_index(postings.where("key < 'k5'"), path, counting, "m")
    index, scope, dropped = indexing.build_index(postings, path, counting, "m")
    assert calls.value == 10 and index.count() == scope.count() == 10 and dropped.count() == 0
    row = index.where("key = 'k1'").first()
    assert row["document"] == "t1\nUlm\nd" and row["metadata"] == {"city": "Ulm", "key": "k1"}
    with pytest.raises(RuntimeError, match="scope is empty"):
        indexing.build_index(postings, str(tmp_path / "other"), lambda t: 1 / 0, "m")


def test_ask_without_hits_still_answers(spark):
    questions = spark.createDataFrame([("q", "why?", [1.0, 0.0])], "query_id string, question string, embedding array<float>")
    t = Inputs(spark, SF)
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    answers, sources = ask(questions, doc_postings(t), empty, lambda ms: [m[-14:] for m in ms], city="en")
    assert answers.first()["answer"] == "Question: why?" and sources.count() == 0


def test_stream_equals_batch_when_files_arrive_one_by_one(spark, tmp_path):
    from gleanboard.operators.dedupe import merge_across_sources
    from gleanboard.streaming.first_wins import ProvenanceLog
    from test_dedupe import SCHEMA, random_rows

    rows = [r for r in random_rows(120, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    landing = tmp_path / "in"
    log = ProvenanceLog(str(tmp_path / "groups"), ["n"])
    for part in range(3):
        df.where(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema(df.schema).parquet(str(landing))
        log.start(stream, str(tmp_path / "marks")).awaitTermination()
    got = sorted((r["n"], tuple(r["found_on"])) for r in log.read(spark).collect())
    wanted = sorted((r["n"], tuple(r["found_on"])) for r in merge_across_sources(df, ["n"]).collect())
    assert got == wanted
