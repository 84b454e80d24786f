"""A scoring pass that is stored bucket by bucket and picks up where it stopped."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from ..operators.passes import Model, PassSpec, ask_model, from_records, read_replies, to_records
from ..session import scratch_path
from ..sources.tables import mark_buckets, mark_finished, read_progress, read_verdicts, write_verdicts

#: Messages between two commits.
BUCKET_ROWS = 10_000
#: Small buckets that are committed together at most.
WAVE_BUCKETS = 64


@dataclass(frozen=True)
class RunStore:
    """Where verdicts are kept and which run to reuse them from."""
    path: str
    run_id: str
    resume: str | None = None
    configured_resume: str | None = None
    bucket_rows: int = BUCKET_ROWS


def _known(spark: SparkSession, store: RunStore, resume: str | None, spec: PassSpec, keys: Sequence[str]) -> DataFrame | None:
    """(keys, _payload, _own): verdicts without an error of this run and the resumed one; the own one wins."""
    runs = [r for r in (store.run_id, resume) if r]
    try:
        records = read_verdicts(spark, store.path, usable=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    records = records.where(F.col("run_id").isin(runs) & (F.col("pass") == spec.name))
    readable = F.try_parse_json("payload").isNotNull()
    first = F.min(F.struct((F.col("run_id") != store.run_id).alias("other"), "payload")).alias("_f")
    return records.where(readable).groupBy(*keys).agg(first).select(
        *keys, F.col("_f.payload").alias("_payload"), (~F.col("_f.other")).alias("_own"))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _waves(states: Sequence[Row]) -> Iterator[list[Row]]:
    """Buckets that are asked and committed together: 1, 2, 4 and so on, up to
    ``WAVE_BUCKETS`` and ``BUCKET_ROWS`` messages; a bucket of that size stays alone."""
    wave: list[Row] = []
    most, messages = 1, 0
    for state in states:
        if wave and (len(wave) == most or messages + state["rows"] > BUCKET_ROWS):
            yield wave
            wave, most, messages = [], min(2 * most, WAVE_BUCKETS), 0
        wave.append(state)
        messages += state["rows"]
    if wave:
        yield wave


def stored_pass(
    rows: DataFrame, model: Model, spec: PassSpec, store: RunStore, keys: Sequence[str] = ("profile_id", "key"), *,
    resume: str | None = None, batch: int = 32, concurrency: int | None = None,
) -> DataFrame:
    """Verdicts of one pass, stored under the run.

    The rows are dealt into buckets by a hash of their keys, about
    ``store.bucket_rows`` each. A bucket is asked, written to its own partition
    and then noted as finished. A commit costs the same however small it is, so
    buckets smaller than ``BUCKET_ROWS`` go in waves that double: a run that dies
    loses one bucket, or small buckets of ``BUCKET_ROWS`` messages in all at most
    and hardly more than it has stored. The same run started again, or another one that
    resumes it, asks only what has no verdict without an error: stored keys are
    found by one join before anything is asked. A bucket with nothing to ask and
    nothing new is not written again. The number of buckets is noted with the
    first one and kept, so a key never moves between partitions.
    """
    keys, spark = list(keys), rows.sparkSession
    noted = {r["bucket"]: r for r in read_progress(spark, store.path, store.run_id).where(F.col("pass") == spec.name).collect()}
    buckets = max((r["buckets"] for r in noted.values()), default=0)
    if not buckets:
        buckets = max(1, math.ceil(rows.count() / store.bucket_rows))
        mark_finished(spark, store.path, store.run_id, spec.name, -1, buckets, 0, 0)
    known = _known(spark, store, resume, spec, keys)
    asked = rows.select(*keys, "message")
    asked = asked.join(known, keys, "left") if known is not None else asked.withColumns(
        {"_payload": F.lit(None).cast("string"), "_own": F.lit(None).cast("boolean")})
    folder = scratch_path(spark, f"pass-{spec.name}")
    dealt = asked.withColumn("_bucket", bucket_of(keys, buckets))
    dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
    dealt = spark.read.schema(dealt.schema).parquet(folder)

    states = dealt.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("_own", F.lit(False))).alias("own")).collect()
    if not states:
        nothing = to_records(read_replies(ask_model(rows.limit(0), model, keys), spec, keys), spec, store.run_id, keys)
        write_verdicts(nothing.withColumn("bucket", F.lit(0)), store.path)
    todo = [r for r in sorted(states, key=lambda r: r["_bucket"])
            if not (r["_bucket"] in noted and noted[r["_bucket"]]["rows"] == r["rows"] == r["own"])]
    bucket = bucket_of(keys, buckets)
    for wave in _waves(todo):
        numbers = [r["_bucket"] for r in wave]
        part = dealt.where(F.col("_bucket").isin(numbers))
        fresh = read_replies(ask_model(part.where("_payload IS NULL"), model, keys, batch=batch, concurrency=concurrency), spec, keys)
        reused = part.where("_payload IS NOT NULL").select(
            F.lit(store.run_id).alias("run_id"), F.lit(spec.name).alias("pass"), *keys,
            F.col("_payload").alias("payload"), F.lit(None).cast("string").alias("error"))
        seen, bad = Observation(), F.coalesce("error", F.lit("")) != ""
        records = to_records(fresh, spec, store.run_id, keys).unionByName(reused).withColumn("bucket", bucket).observe(
            seen, *[F.count_if(bad & (F.col("bucket") == n)).alias(f"failed{n}") for n in numbers])
        # Verdicts are short: those of a small bucket go to one file.
        write_verdicts(records.repartition("bucket") if len(wave) > 1 else records, store.path)
        mark_buckets(spark, store.path, [
            (store.run_id, spec.name, r["_bucket"], buckets, r["rows"], seen.get[f"failed{r['_bucket']}"]) for r in wave])
    # An earlier attempt may have stored keys that are not asked for now.
    return from_records(read_verdicts(spark, store.path, store.run_id), spec, keys).join(dealt.select(*keys), keys, "left_semi")
