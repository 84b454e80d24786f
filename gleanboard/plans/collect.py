"""Collecting: several sources to one deduplicated, keyed table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.dedupe import first_hits, merge_across_sources, with_keys
from ..operators.filters import keyword_hits, matching_queries
from ..operators.summary import counted_by
from ..schemas import COLLECTED, POSTING, conform
from ..session import scratch_path
from ..sources.boards import board, read_board

ORDER = ["source_ord", "row_ord"]


def require_search(title: str, country: str) -> None:
    """Checked before any plan is built."""
    missing = [name for name, value in (("country", country), ("title", title)) if not value]
    if missing:
        raise ValueError(f"search needs a {' and a '.join(missing)}")


def clean_queries(values: Sequence[object], dedupe: bool = True) -> list[str]:
    """Stripped, non-blank queries in order; the first spelling wins."""
    kept: dict[str, str] = {}
    for i, value in enumerate(values):
        text = "" if value is None else str(value).strip()
        if text:
            kept.setdefault(text.lower() if dedupe else f"{i}", text)
    return list(kept.values())


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name in the given order, tagged with actor and ordinals."""
    tagged = [
        conform(df.withColumn("actor", F.lit(name)).withColumn("source_ord", F.lit(i)), COLLECTED,
                keep=tuple(df.columns))
        for i, (name, df) in enumerate(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_sources(
    spark: SparkSession, paths: dict[str, str], now: dt.datetime
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Readable sources and the errors of the others. An unknown name is an
    error; a failing source is skipped and the others go on."""
    frames, failed = {}, {}
    for name, path in paths.items():
        board(name)
        try:
            frames[name] = read_board(spark, name, path, now)
        except Exception as e:  # noqa: BLE001 - per-source isolation
            failed[name] = str(e)
    return frames, failed


def collect_postings(frames: dict[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Tag, union, merge across sources and key. No source gives no rows."""
    if not frames:
        spark = spark or SparkSession.active()
        frames = {"": spark.createDataFrame([], POSTING)}
    return with_keys(merge_across_sources(union_sources(frames), ORDER)).drop(*ORDER)


def ingest(frames: dict[str, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Land the tagged union, merge it, store both, and count in passing.

    Returns (unique postings, summary): rows per source, ``raw total`` and ``unique
    total`` as (label, rows). The counts are taken while the two tables are written
    (``path``/raw and ``path``/unique), so nothing is read for them.
    """
    spark = next(iter(frames.values())).sparkSession
    raw, seen = counted_by(union_sources(frames), "actor", list(frames), "raw total")
    raw.write.mode("overwrite").parquet(f"{path}/raw")
    kept = Observation()
    merged = with_keys(merge_across_sources(spark.read.parquet(f"{path}/raw"), ORDER, counted=True)).drop(*ORDER)
    merged.observe(kept, F.count(F.lit(1)).alias("unique total")).write.mode("overwrite").parquet(f"{path}/unique")
    rows = [(name, seen.get[f"n{i}"]) for i, name in enumerate(frames)]
    rows += [("raw total", seen.get["raw total"]), ("unique total", kept.get["unique total"])]
    return spark.read.parquet(f"{path}/unique"), spark.createDataFrame(rows, "label string, rows bigint")


def run_portfolio(
    postings: DataFrame, queries: Sequence[object], order_by: Sequence[str] = tuple(ORDER), *,
    done: Sequence[str] = (), columns: Sequence[str] = ("title", "description"),
    merge_found_on: bool = False, counted: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(unique postings, hits per query) of a portfolio over a landed table.

    ``done`` holds labels of queries that ran before and are skipped. Each
    query merges its own hits; across queries the earlier query wins. ``counted``
    groups the hits at once (``merge_across_sources``), for callers that store both.
    """
    wanted = _pending(queries, done)
    hits = keyword_hits(postings, wanted, columns)
    tags = ["query_ord", "search_label", "search_query"]
    per_query = with_keys(merge_across_sources(hits, order_by, within=tags, counted=counted))
    found = F.transform(matching_queries(wanted, columns), lambda q: q["query_ord"])
    unique = first_hits(postings, found, order_by, merge_found_on=merge_found_on, counted=counted)
    return with_keys(unique), per_query


def _label(query: str) -> str:
    return "_".join(query.lower().split())


def _pending(queries: Sequence[object], done: Sequence[str]) -> list[str]:
    return [q for q in clean_queries(queries) if _label(q) not in set(done)]


def store_portfolio(
    postings: DataFrame, queries: Sequence[object], path: str, order_by: Sequence[str] = tuple(ORDER), *,
    done: Sequence[str] = (), **options,
) -> tuple[DataFrame, DataFrame]:
    """``run_portfolio`` written to ``path``/hits and ``path``/unique: (unique postings, summary).

    The summary has the jobs of every query, ``hit total`` and ``unique total`` as
    (label, rows), counted while the tables are written. The postings that any query
    finds are landed first: both tables read them several times.
    """
    wanted = _pending(queries, done)
    spark, landed = postings.sparkSession, scratch_path(postings.sparkSession, "found")
    columns = options.get("columns", ("title", "description"))
    found = postings.where(F.size(matching_queries(wanted, columns)) > 0)
    found.write.parquet(landed)
    unique, per_query = run_portfolio(spark.read.schema(found.schema).parquet(landed), queries, order_by, done=done, counted=True, **options)
    labels = [_label(q) for q in wanted]
    hits, seen = counted_by(per_query, "search_label", labels, "hit total")
    hits.write.mode("overwrite").parquet(f"{path}/hits")
    kept = Observation()
    unique.observe(kept, F.count(F.lit(1)).alias("unique total")).write.mode("overwrite").parquet(f"{path}/unique")
    rows = [(name, seen.get[f"n{i}"]) for i, name in enumerate(labels)]
    rows += [("hit total", seen.get["hit total"]), ("unique total", kept.get["unique total"])]
    return spark.read.parquet(f"{path}/unique"), spark.createDataFrame(rows, "label string, rows bigint")
