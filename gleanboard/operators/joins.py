"""The joins of the jobs, by what they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import RECRUITER_WEIGHTS


# About 30 MB of hits: the most that is broadcast.
SMALL_ROWS = 200_000


def small_side(stored: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a stored table of few, short rows.

    The rows are counted first, since Spark does not know the size of a
    checkpointed table. A larger one is left to a shuffled join.
    """
    return F.broadcast(stored) if stored.count() <= rows else stored


def postings_of(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """The postings any stored hit points to. One scan of the big table, which
    is not shuffled while the hits are few; later steps read only the result."""
    return postings.join(small_side(hits.select("key")), "key", "left_semi")


def rows_of_hits(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Full rows of the hits; ``rank`` carries the order."""
    return hits.join(postings, "key")


def only_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str] = "key") -> DataFrame:
    return df.join(keys, on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str] = "key") -> DataFrame:
    return df.join(keys, on, "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def key_difference(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def with_verdicts(survivors: DataFrame, candidate: DataFrame, recruiter: DataFrame,
                  on: Sequence[str] = ("key",)) -> DataFrame:
    """Left joins of both verdict sets; of the recruiter pass only the ratings,
    the score and the notes."""
    kept = [*on, *RECRUITER_WEIGHTS, "recruiter_score", "recruiter_notes"]
    return survivors.join(candidate, list(on), "left").join(recruiter.select(*kept), list(on), "left")


def split_by_cache(rows: DataFrame, cache: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, pending): records without an error are reused."""
    usable = cache.where(F.coalesce("error", F.lit("")) == "")
    reused = rows.join(usable, list(on))
    pending = rows.join(usable.select(*on), list(on), "left_anti")
    return reused, pending
