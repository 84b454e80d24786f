"""Row predicates. All are plain column expressions that reach the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import posted_since_cutoff, recency_cutoff
from ..functions.text import blank_to_null, first_filled, query_label

# Tags that mark a remote job.
REMOTE_TAGS = ["remote", "fully-remote", "100-remote", "work-from-home"]
BLOCKED_TYPE = "job_wwr_blocked"


def effective_source() -> Column:
    """The board a row came from, else the reader that produced it."""
    return first_filled(F.col("source_platform"), F.col("actor"))


def recent(df: DataFrame, phrase: str, now: dt.datetime, column: str = "posted_at") -> DataFrame:
    """Keep rows without a date and rows not older than the phrase."""
    cutoff = recency_cutoff(phrase, now)
    return df.where(F.col(column).isNull() | (F.col(column) >= F.lit(cutoff)))


def posted_within(df: DataFrame, within: str, now: dt.datetime, column: str = "posted_at") -> DataFrame:
    cutoff = posted_since_cutoff(within, now)
    return df if cutoff is None else df.where(F.col(column) >= F.lit(cutoff))


def is_remote(flag: Column, tags: Column) -> Column:
    tagged = F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(t) for t in REMOTE_TAGS]))
    return F.coalesce(flag, F.lit(False)) | F.coalesce(tagged, F.lit(False))


def location_matches(location: Column, needle: str) -> Column:
    """Substring match; places open to everybody always pass."""
    if not needle:
        return F.lit(True)
    low = F.lower(location)
    return F.coalesce(
        F.when(location == "", False)
        .otherwise(F.contains(low, F.lit("worldwide")) | F.contains(low, F.lit("anywhere"))
                   | F.contains(low, F.lit(needle.lower()))), F.lit(False))


def without_sentinel(df: DataFrame, column: str = "type", value: str = BLOCKED_TYPE) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(value))


def metadata_filter(df: DataFrame, **equals: str | None) -> DataFrame:
    """AND of exact equalities over the values that are not blank."""
    clauses = [F.col(c) == v for c, v in equals.items() if v]
    return df.where(reduce(lambda a, b: a & b, clauses)) if clauses else df


def in_metadata(df: DataFrame, column: str = "metadata", **equals: str | None) -> DataFrame:
    """The same over a map of texts, as the index carries it: its rows are cut before they are scored."""
    clauses = [F.col(column)[c] == v for c, v in equals.items() if v]
    return df.where(reduce(lambda a, b: a & b, clauses)) if clauses else df


def not_rejected(decision: Column) -> Column:
    """Fail-open: everything but a clean 'reject' survives."""
    return F.lower(F.coalesce(decision, F.lit(""))) != "reject"


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(F.col(column) >= threshold)


def found_on(platform: str) -> Column:
    return F.array_contains("found_on", platform)


def facets(
    df: DataFrame,
    *,
    employment_types: Sequence[str] = (),
    category: str = "",
    company: str = "",
    regions: Sequence[str] = (),
    region_column: str = "country",
    min_salary: float | None = None,
    salary_column: str = "salary",
    worldwide_only: bool = False,
) -> DataFrame:
    """Conjunction of the facets that are set. A salary that is not a number
    never excludes a row."""
    if employment_types:
        df = df.where(F.lower("employment_type").isin([t.lower() for t in employment_types]))
    if category:
        df = df.where(F.col("category") == category)
    if company:
        df = df.where(F.contains(F.lower("employer_name"), F.lit(company.lower())))
    if regions:
        low = F.lower(region_column)
        df = df.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(r.lower())) for r in regions]))
    if min_salary:
        salary = F.col(salary_column).try_cast("double")
        df = df.where(salary.isNull() | (salary >= float(min_salary)))
    if worldwide_only:
        df = df.where(blank_to_null(F.col(region_column)).isNull())
    return df


def matching_queries(queries: Sequence[str], columns: Sequence[str] = ("title", "description")) -> Column:
    """The queries that the text of a row contains, as structs, any case."""
    if not queries:
        raise ValueError("enter at least one query")
    portfolio = F.array(*[
        F.struct(F.lit(i).alias("query_ord"), F.lit(q).alias("search_query"),
                 F.lit(q.strip().lower()).alias("needle")) for i, q in enumerate(queries)])
    text = F.lower(F.concat_ws("\n", *columns))
    return F.get(F.transform(F.array(text), lambda t: F.filter(portfolio, lambda q: F.contains(t, q["needle"]))), F.lit(0))


def keyword_hits(df: DataFrame, queries: Sequence[str], columns: Sequence[str] = ("title", "description")) -> DataFrame:
    """One row per (row, query) whose text contains the query, any case.

    The portfolio is a list typed by a person, so it travels inside the plan
    as one constant array: no join, and the text is lowered once per row.
    """
    return (df.select("*", F.explode(matching_queries(queries, columns)).alias("_q"))
            .select(*df.columns, "_q.query_ord", query_label(F.col("_q.search_query")).alias("search_label"),
                    "_q.search_query"))
