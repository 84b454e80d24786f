"""Counts and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.scores import rescaled, weighted_mean


def rows_per(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def ingest_summary(raw: DataFrame, unique: DataFrame, by: str) -> DataFrame:
    """Rows per ``by``, the raw total and the unique total, as (label, rows)."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("label"), "rows")

    per = rows_per(raw, by).select(F.col(by).cast("string").alias("label"), "rows")
    return per.unionByName(total(raw, "raw total")).unionByName(total(unique, "unique total"))


def counted_by(df: DataFrame, by: str, labels: Sequence[str], total: str) -> tuple[DataFrame, Observation]:
    """The table with counts that Spark takes while it is written: per label of ``by`` and of all rows."""
    seen = Observation()
    counts = [F.count_if(F.col(by).eqNullSafe(F.lit(label))).alias(f"n{i}") for i, label in enumerate(labels)]
    return df.observe(seen, F.count(F.lit(1)).alias(total), *counts), seen


def cache_ratio(rows: DataFrame, cached: Column, by: str = "pass") -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(cached).alias("reused"), F.count(F.lit(1)).alias("rows"))


def dropped_rows(embedded: DataFrame) -> DataFrame:
    """Keys whose text could not be embedded, as a table of any length."""
    return embedded.where(F.col("embedding").isNull()).select("key")


def coverage(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Whether every hit exists in the table, and the number of hits."""
    known = table.select("key").distinct().withColumn("_known", F.lit(True))
    return hits.join(known, "key", "left").agg(
        F.coalesce(F.bool_and(F.coalesce("_known", F.lit(False))), F.lit(True)).alias("all_known"),
        F.count(F.lit(1)).alias("hits"))


def with_combined_score(df: DataFrame, recruiter_weight: float = 0.6, candidate_weight: float = 0.4) -> DataFrame:
    """Both scores on 0-1 over the whole table, and their weighted mean.

    The bounds are one scalar subquery: one aggregate over the table, no join.
    """
    bounds = df.select(F.struct(
        F.min("recruiter_score").alias("r_low"), F.max("recruiter_score").alias("r_high"),
        F.min("candidate_score").alias("c_low"), F.max("candidate_score").alias("c_high")).alias("b")).scalar()
    return (
        df.withColumn("_b", bounds)
        .withColumn("recr_rescaled", rescaled(F.col("recruiter_score"), F.col("_b.r_low"), F.col("_b.r_high")))
        .withColumn("cand_rescaled", rescaled(F.col("candidate_score"), F.col("_b.c_low"), F.col("_b.c_high")))
        .drop("_b")
        .withColumn("combined_score", weighted_mean(
            [(F.col("recr_rescaled"), recruiter_weight), (F.col("cand_rescaled"), candidate_weight)])))
