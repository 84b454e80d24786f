"""Matching profiles with postings: a cascade whose passes get dearer and
whose tables get smaller."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import CANDIDATE_WEIGHTS, RECRUITER_WEIGHTS, candidate_score, recruiter_score
from ..functions.text import cv_message, posting_text, profile_message
from ..operators.dedupe import require_unique_key
from ..operators.filters import at_least, not_rejected, recent
from ..operators.joins import postings_of, with_verdicts
from ..operators.nearest import search
from ..operators.passes import (CANDIDATE, PRESCREEN, PROFILE_CODING, RECRUITER, Model, PassSpec, ask_model,
                                read_replies, score_pass)
from ..operators.ranking import final_order, rank_within, rescored_order, top_percent
from ..schemas import THEME_LISTS
from ..session import settle
from ..sources.tables import previous_run, preview, register_run
from .stored_pass import RunStore, stored_pass

KEYS = ["profile_id", "key"]


@dataclass(frozen=True)
class MatchSettings:
    # The defaults of a run.
    top_n: int = 200
    keep_pct: float = 30
    concurrency: int = 8
    batch: int = 32
    max_description: int | None = None
    recruiter_weights: dict[str, float] = field(default_factory=lambda: dict(RECRUITER_WEIGHTS))
    candidate_weights: dict[str, float] = field(default_factory=lambda: dict(CANDIDATE_WEIGHTS))


@dataclass(frozen=True)
class Models:
    prescreen: Model
    recruiter: Model
    candidate: Model


def code_profiles(cvs: DataFrame, model: Model, concurrency: int | None = None) -> DataFrame:
    """(profile_id, cv_text) to profiles with theme lists and a search query."""
    replies = ask_model(cvs.withColumn("message", F.col("cv_text")), model, ["profile_id"], concurrency=concurrency)
    return read_replies(replies, PROFILE_CODING, ["profile_id"]).join(cvs, "profile_id")


class _Cascade:
    def __init__(self, postings, models, settings, now, store):
        self.postings, self.models, self.settings, self.now = postings, models, settings, now
        self.store, self.spark = store, postings.sparkSession
        self.resume = store and previous_run(self.spark, store.path, store.resume, store.configured_resume)

    def run_pass(self, rows: DataFrame, spec: PassSpec, model: Model) -> DataFrame:
        """Verdicts computed once: stored under the run bucket by bucket, or checkpointed."""
        options = {"batch": self.settings.batch, "concurrency": self.settings.concurrency}
        if self.store:
            return stored_pass(rows, model, spec, self.store, KEYS, resume=self.resume, **options)
        return settle(score_pass(rows, model, spec, KEYS, **options))

    def cv_rows(self, keys: DataFrame, profiles: DataFrame) -> DataFrame:
        posting = posting_text(self.settings.max_description)
        return (keys.select(*KEYS).join(profiles.select("profile_id", "cv_text"), "profile_id")
                .join(self.postings, "key")
                .select(*KEYS, cv_message(F.col("cv_text"), posting, self.now).alias("message")))

    def profile_rows(self, keys: DataFrame, profiles: DataFrame) -> DataFrame:
        posting = posting_text(self.settings.max_description)
        profile = F.struct(*THEME_LISTS, "search_query").alias("_profile")
        return (keys.select(*KEYS).join(profiles.select("profile_id", profile), "profile_id")
                .join(self.postings, "key")
                .select(*KEYS, profile_message(F.col("_profile"), posting).alias("message")))


def match(
    profiles: DataFrame, postings: DataFrame, index: DataFrame, models: Models, *,
    now: dt.datetime, settings: MatchSettings = MatchSettings(), store: RunStore | None = None,
    prescreen_only: bool = False, posted_since: str | None = None, runs_path: str = "",
    table_order: Sequence[str] = (),
) -> DataFrame:
    """Ranked matches per profile.

    ``profiles`` carry cv_text, the theme lists and ``embedding`` of the search
    query. Retrieval sees only postings of the given table (and, with
    ``posted_since``, recent ones). With ``prescreen_only`` the surviving
    postings come back unscored, with their ``position`` in ``table_order`` (columns
    of the postings, then the key). A key that two retrieved postings share is an error.
    """
    profiles = settle(profiles)  # a model made them: once
    if posted_since:
        postings = recent(postings, posted_since, now)
    if store:
        register_run(postings.sparkSession, runs_path, store.run_id, now, asdict(settings), profiles)
    c = _Cascade(postings, models, settings, now, store)
    queries = profiles.select(F.col("profile_id").alias("query_id"), "embedding")
    hits = settle(search(index, queries, settings.top_n, scope=postings).withColumnRenamed("query_id", "profile_id"))
    # From here on every step works on the retrieved postings only.
    postings = c.postings = require_unique_key(settle(postings_of(hits, postings)))

    screened = c.run_pass(c.cv_rows(hits, profiles), PRESCREEN, models.prescreen)
    survivors = hits.join(screened.where(not_rejected(F.col("decision"))), KEYS, "left_semi")
    if prescreen_only:
        kept = survivors.select(*KEYS).join(postings, "key")
        return rank_within(kept, ["profile_id"], [*[F.asc(c) for c in table_order], F.asc("key")], "position")

    rated = c.run_pass(c.cv_rows(survivors, profiles), RECRUITER, models.recruiter)
    rated = rated.withColumn("recruiter_score", recruiter_score(settings.recruiter_weights))
    finalists = top_percent(
        survivors.join(rated.select(*KEYS, "recruiter_score"), KEYS), settings.keep_pct,
        [F.desc("recruiter_score"), F.asc("rank")], ["profile_id"], bounded_groups=True)

    judged = c.run_pass(c.profile_rows(finalists, profiles), CANDIDATE, models.candidate)
    judged = judged.withColumn("candidate_score", candidate_score(settings.candidate_weights)).drop("cached")
    chosen = judged.select(*KEYS).join(postings, "key")
    result = with_verdicts(chosen, judged, rated, KEYS)
    return rank_within(result, ["profile_id"], [*final_order(), F.asc("key")])


def rescore(
    matches: DataFrame, recruiter_weights: dict[str, float], candidate_weights: dict[str, float],
    threshold: float | None = None,
) -> DataFrame:
    """New weights over stored ratings and lists: a projection, no model call.
    The caller sorts with ``rescored_order`` (recruiter score first)."""
    out = matches.withColumn("recruiter_score", recruiter_score(recruiter_weights)) \
        .withColumn("candidate_score", candidate_score(candidate_weights))
    return out if threshold is None else at_least(out, "recruiter_score", threshold)


# Columns and headings of the results table.
RESULT_COLUMNS = ["title", "employer_name", "city", "posted_at", "recruiter_score", "candidate_score",
                  "found_on", "job_url", "platform_url", "description", "recruiter_notes"]
RESULT_HEADINGS = {"recruiter_score": "rec_sc", "candidate_score": "cand_sc"}


def rescored_preview(matches: DataFrame, recruiter_weights: dict[str, float],
                     candidate_weights: dict[str, float], threshold: float = 65) -> DataFrame:
    ranked = rescore(matches, recruiter_weights, candidate_weights, threshold).orderBy(*rescored_order())
    return preview(ranked, RESULT_COLUMNS, RESULT_HEADINGS)

