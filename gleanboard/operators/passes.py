"""Scoring passes: one batched model call per row, isolated and reusable."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import verdicts as v
from ..functions.scores import candidate_score, recruiter_score
from ..schemas import RATINGS, TEXTS, THEME_LISTS, VERDICT_LISTS
from ..session import bounded_batches
from .joins import split_by_cache

# A model takes the messages of a batch and returns one text per message.
Model = Callable[[list[str]], list[str]]


class ModelStopped(Exception):
    """Raised by a model that must not be asked any more (quota used up, access
    withdrawn). It ends the job; other errors belong to their message alone."""


@dataclass(frozen=True)
class PassSpec:
    name: str
    read: Callable[..., list[Column]]
    fields: StructType

    @property
    def columns(self) -> list[str]:
        return self.fields.names


def _fields(**kinds: str | ArrayType) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


PRESCREEN = PassSpec("prescreen", v.read_prescreen, _fields(decision="string", prescreen_notes="string"))
RECRUITER = PassSpec("recruiter", v.read_recruiter,
                     _fields(**{r: "integer" for r in RATINGS}, recruiter_notes="string"))
CANDIDATE = PassSpec("candidate", v.read_candidate, _fields(**{n: TEXTS for n in VERDICT_LISTS}))
PROFILE_CODING = PassSpec("profile", v.read_profile,
                          _fields(**{n: TEXTS for n in THEME_LISTS}, search_query="string"))
PASSES = {p.name: p for p in (PRESCREEN, RECRUITER, CANDIDATE)}


def call_each(model: Model, messages: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) per message. If the batch fails, each message is sent
    alone, so one bad row cannot spoil its neighbours."""
    try:
        replies = list(model(messages))
        if len(replies) != len(messages):
            raise ValueError(f"{len(replies)} replies for {len(messages)} messages")
        return [(r, None) for r in replies]
    except ModelStopped:
        raise
    except Exception as batch_error:  # noqa: BLE001 - user code
        if len(messages) == 1:
            return [(None, str(batch_error) or type(batch_error).__name__)]
        return [pair for m in messages for pair in call_each(model, [m])]


def ask_model(rows: DataFrame, model: Model, keys: Sequence[str], *, batch: int = 32,
              concurrency: int | None = None) -> DataFrame:
    """keys + ``reply`` and ``call_error``; ``rows`` has a ``message`` column.

    ``concurrency`` is what the model allows and sets the number of tasks;
    messages reach a task in batches of bounded bytes.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.select(*keys, "message")
    if concurrency:
        rows = rows.repartition(concurrency, *keys)
    schema = StructType([rows.schema[k] for k in keys]).add("reply", StringType()).add("call_error", StringType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                pairs = call_each(model, list(part["message"]))
                yield part[list(keys)].assign(reply=[p[0] for p in pairs], call_error=[p[1] for p in pairs])

    return rows.mapInPandas(run, schema)


def read_replies(replies: DataFrame, spec: PassSpec, keys: Sequence[str]) -> DataFrame:
    """Clean verdict columns of one pass, with ``error`` where it failed."""
    parsed = replies.withColumn("_json", v.loose_json(F.col("reply")))
    return parsed.select(*keys, *spec.read(F.col("_json"), F.col("reply"), F.col("call_error"), F.col(keys[-1])))


def score_pass(
    rows: DataFrame, model: Model, spec: PassSpec, keys: Sequence[str] = ("profile_id", "key"), *,
    cache: DataFrame | None = None, batch: int = 32, concurrency: int | None = None,
) -> DataFrame:
    """Verdicts of one pass for every row, from the cache where it has one.

    Write or checkpoint the result before using it twice: a model call is not
    free and Spark recomputes what is not stored.
    """
    keys = list(keys)
    if cache is None:
        return read_replies(ask_model(rows, model, keys, batch=batch, concurrency=concurrency), spec, keys) \
            .withColumn("cached", F.lit(False))
    reused, pending = split_by_cache(rows.select(*keys, "message"), cache.select(*keys, *spec.columns, "error"), keys)
    fresh = read_replies(ask_model(pending, model, keys, batch=batch, concurrency=concurrency), spec, keys)
    return fresh.withColumn("cached", F.lit(False)).unionByName(
        reused.select(*keys, *spec.columns, "error").withColumn("cached", F.lit(True)))


def to_records(verdicts: DataFrame, spec: PassSpec, run_id: str, keys: Sequence[str] = ("profile_id", "key")) -> DataFrame:
    """Rows of the verdict table."""
    return verdicts.select(
        F.lit(run_id).alias("run_id"), F.lit(spec.name).alias("pass"), *keys,
        F.to_json(F.struct(*spec.columns)).alias("payload"), "error")


def from_records(records: DataFrame, spec: PassSpec, keys: Sequence[str] = ("profile_id", "key")) -> DataFrame:
    """Verdict columns of the stored rows of one pass; an unreadable payload
    counts as an error."""
    body = F.from_json("payload", spec.fields)
    broken = F.try_parse_json("payload").isNull()
    return (records.where(F.col("pass") == spec.name)
            .select(*keys, body.alias("_v"), F.when(broken, F.lit("unreadable record")).otherwise(F.col("error")).alias("error"))
            .select(*keys, "_v.*", "error"))


def scored_recruiter(verdicts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return verdicts.withColumn("recruiter_score", recruiter_score(weights))


def scored_candidate(verdicts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return verdicts.withColumn("candidate_score", candidate_score(weights))
