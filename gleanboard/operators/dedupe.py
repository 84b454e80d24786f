"""Duplicate resolution. Two rules that must not be mixed up:

``merge_across_sources`` compares normalised text, never merges rows with a
blank part and keeps the provenance of all copies. ``keep_first`` compares raw
values, where null equals null, and keeps one row as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.keys import match_key, posting_key
from ..functions.text import NOT_SPACE, form_text, match_text
from ..session import settle
from .filters import effective_source
from .joins import small_side

TRIPLE = ["employer_name", "title", "city"]
DUPLICATE_REPORT = ["key", "title", "employer_name", "city", "found_on"]


def has_match_parts(columns: Sequence[str] = TRIPLE) -> Column:
    """True where every normalised part is present: a part that is not only white space."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).rlike(NOT_SPACE), F.lit(False)) for c in columns])


def first_row(df: DataFrame, order_by: Sequence[str | Column], payload: Sequence[str]) -> Column:
    """Aggregate: the payload of the row that comes first in ``order_by``.

    The order values lead one struct whose minimum is taken, so nothing is
    carried twice and equal orders are settled by the payload. Only payloads
    that cannot be compared (maps, variants) need the two-part form.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    if any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in payload):
        return F.min_by(F.struct(*payload), F.struct(*order))
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    named = {o: f"_o{i}" for i, o in enumerate(order_by) if isinstance(o, str)}
    best = F.min(F.struct(*keys, *[c for c in payload if c not in named]))
    return F.struct(*[best[named.get(c, c)].alias(c) for c in payload])


def _hash_pair(columns: Sequence[str | Column], names: tuple[str, str]) -> list[Column]:
    """128 bits that stand for the values of some columns; nulls count as values."""
    return [F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(names[1]), *columns).alias(names[1])]


ROW = ("_row", "_row2")
GROUP = ("_group", "_group2")


def located(df: DataFrame) -> DataFrame:
    """Rows with the hashes by which they are found again. Maps and variants are not hashed."""
    plain = [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.select("*", *_hash_pair(plain, ROW))


def fetch(df: DataFrame, winners: DataFrame, counted: bool = False) -> DataFrame:
    """The rows of ``located(df)`` that ``winners`` (ROW and more) name, each once, with what the winners carry.

    Wide rows are moved here only. ``counted`` stores and counts the winners first:
    while they are few they are broadcast, and just the winning rows are put in order.
    """
    winners = small_side(settle(winners)) if counted else winners
    once = Window.partitionBy(*ROW).orderBy(ROW[0])
    return (located(df).join(winners, list(ROW)).withColumn("_copy", F.row_number().over(once))
            .where(F.col("_copy") == 1).drop("_copy", *ROW))


def _at(order_by: Sequence[str | Column]) -> Column:
    """What decides among the rows of a group: the order, then the hash of the row."""
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    return F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *ROW).alias("_at")


def merge_across_sources(
    df: DataFrame,
    order_by: Sequence[str],
    *,
    within: Sequence[str] = (),
    source: Column | None = None,
    drop: Sequence[str] = ("actor", "source_platform"),
    counted: bool = False,
) -> DataFrame:
    """One row per job with the sorted distinct sources it was found on.

    Only hashes of the normalised triple and of the row, the order values and the
    source are grouped; the aggregates combine before the shuffle, so a job listed
    very often sends one narrow row per map task. The survivor is the first row in
    ``order_by``; its wide row is then fetched by its hash. Rows with a blank part
    are no group: they pass by as they are and are never moved. ``df`` is read
    three times: store it first if it is dear to compute. ``counted`` groups at once
    and counts the winners (``fetch``), for callers that store the result anyway;
    without it nothing runs before the result does.
    """
    source = effective_source() if source is None else source
    payload = [c for c in df.columns if c not in {*within, *drop}]
    complete = has_match_parts()
    parts = [*within, *[match_text(F.col(c)) for c in TRIPLE]]
    narrow = located(df.where(complete)).select(*_hash_pair(parts, GROUP), _at(order_by), source.alias("_source"))
    winners = narrow.groupBy(*GROUP).agg(F.min("_at").alias("_at"), F.array_sort(F.collect_set("_source")).alias("found_on"))
    # No row with a blank part has the hash of a winner.
    merged = fetch(df, winners.select(*[F.col("_at")[c].alias(c) for c in ROW], F.col("found_on").alias("_found_on")), counted)
    alone = df.where(~complete).withColumn("_found_on", F.array_compact(F.array(source)))
    kept = [*within, *payload, F.col("_found_on").alias("found_on")]
    return merged.select(*kept).unionByName(alone.select(*kept))


def keep_first(
    df: DataFrame,
    order_by: Sequence[str | Column],
    *,
    by: Sequence[str] = TRIPLE,
    drop: Sequence[str] = (),
    merge_found_on: bool = False,
) -> DataFrame:
    """The first row of each group of equal raw values; nulls are equal.

    ``by`` is cut to the columns that exist; without any the rows pass through.
    Hashes of ``by`` and of the row are grouped, the winners' rows fetched.
    ``merge_found_on`` unites the provenance instead of keeping the winner's.
    """
    by = [c for c in by if c in df.columns]
    kept = [c for c in df.columns if c not in drop]
    if not by:
        return df.select(*kept)
    carried = ["found_on"] if merge_found_on else []
    narrow = located(df).select(*_hash_pair(by, GROUP), _at(order_by), *carried)
    aggregates = [F.min("_at").alias("_at")]
    if merge_found_on:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found_on")))).alias("_found_on"))
    winners = narrow.groupBy(*GROUP).agg(*aggregates)
    found = fetch(df, winners.select(*[F.col("_at")[c].alias(c) for c in ROW], *[f"_{c}" for c in carried]))
    return found.select(*[F.col("_found_on").alias(c) if c in carried else F.col(c) for c in kept])


def keep_first_of_queries(df: DataFrame, order_by: Sequence[str], merge_found_on: bool = False) -> DataFrame:
    """Across a portfolio the earliest query keeps the job."""
    return keep_first(df, ["query_ord", *order_by], merge_found_on=merge_found_on,
                      drop=("query_ord", "search_label", "search_query"))


def first_spellings(df: DataFrame, value: str, order_by: Sequence[str], dedupe: bool = True) -> DataFrame:
    """Clean a list held as a table: strip, drop blanks, and per value without
    regard to case keep the first spelling."""
    clean = df.withColumn(value, form_text(F.col(value))).where(F.col(value) != "")
    if not dedupe:
        return clean
    return (clean.groupBy(F.lower(value).alias("_folded"))
            .agg(first_row(clean, order_by, clean.columns).alias("_first"))
            .select("_first.*"))


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("key", posting_key()).withColumn("match_key", match_key())


def duplicated_keys(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_report(df: DataFrame, key: str = "key", columns: Sequence[str] = DUPLICATE_REPORT) -> DataFrame:
    """All members of duplicated groups. The counting combines before its
    shuffle; the semi join may split a hot key over several tasks."""
    return df.join(duplicated_keys(df, key).select(key), key, "left_semi").select(
        *[c for c in columns if c in df.columns])


def require_unique_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Pass the table through, or raise with the number of offending rows."""
    if key not in df.columns:
        raise ValueError(f"table has no {key!r} column")
    rows = duplicated_keys(df, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if rows:
        raise ValueError(f"found {rows} rows with duplicate keys")
    return df


def first_hits(df: DataFrame, matches: Column, order_by: Sequence[str], *, merge_found_on: bool = False,
               counted: bool = False) -> DataFrame:
    """The jobs that any query of a portfolio finds, each as its first query finds it.

    ``matches`` gives the numbers of the queries that find a row. The same as
    merging every query's hits across sources and keeping the first of equal raw
    values across queries, but only hashes, orders and sources are multiplied by
    the queries; the text of a job is fetched once, when the winner is known.
    """
    hits = located(df).select(
        *_hash_pair([match_text(F.col(c)) for c in TRIPLE], GROUP), *_hash_pair([c for c in TRIPLE if c in df.columns], ("_raw", "_raw2")),
        _at(order_by), has_match_parts().alias("_complete"), effective_source().alias("_source"), F.explode(matches).alias("_query"))
    # Of the rows of a job the first stands for it, also with its raw values.
    first = F.min(F.struct("_at", "_raw", "_raw2")).alias("_first")
    merged = hits.where("_complete").groupBy("_query", *GROUP).agg(first, F.array_sort(F.collect_set("_source")).alias("_found_on")).select(
        "_query", "_first.*", "_found_on")
    alone = hits.where("NOT _complete").select("_query", "_at", "_raw", "_raw2", F.array_compact(F.array("_source")).alias("_found_on"))
    every = merged.unionByName(alone)
    aggregates = [F.min(F.struct("_query", "_at", "_found_on")).alias("_best")]
    if merge_found_on:
        aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_found_on")))).alias("_all"))
    best = every.groupBy("_raw", "_raw2").agg(*aggregates)
    sources = F.col("_all") if merge_found_on else F.col("_best._found_on")
    winners = best.select(*[F.col("_best._at")[c].alias(c) for c in ROW], sources.alias("_sources"))
    found = fetch(df, winners, counted)
    dropped = {"actor", "source_platform"}
    return found.select(*[c for c in df.columns if c not in dropped], F.col("_sources").alias("found_on"))
