"""Ranks, top-k and percent cuts that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .joins import small_side

OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition, then offset


def rank_within(df: DataFrame, group: Sequence[str], order_by: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Row numbers per group, for groups whose size has a bound (top-k hits)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)))


def global_rank(
    df: DataFrame, order_by: Sequence[Column], group: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Row numbers over a table of any size, per group or over all rows.

    Rows are range partitioned and sorted, so a hot group spreads over as many
    tasks as it needs. The position inside a partition comes with the row; the
    number of rows before each partition is summed from one small count per
    partition. ``order_by`` should be a total order.
    """
    order = [F.col(g) for g in group] + list(order_by)
    placed = settle(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", OFFSET_BITS)
    offset = F.col("_at").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))
    placed = placed.withColumn("_part", part).withColumn("_offset", offset).drop("_at")
    # One row per partition: safe to number in one task.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(starts), "_part").withColumn(rank, F.col("_before") + F.col("_offset") + 1)
    if group:
        firsts = (placed.groupBy(*group, "_part").agg(F.min("_offset").alias("_offset"))
                  .join(F.broadcast(starts), "_part")
                  .groupBy(*[F.col(g).alias(f"_g_{g}") for g in group])
                  .agg(F.min(F.col("_before") + F.col("_offset")).alias("_first")))
        same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
        # A row per group: few groups are broadcast, so that a hot one is not gathered again.
        out = out.join(small_side(settle(firsts)), same).withColumn(rank, F.col(rank) - F.col("_first"))
    return out.select(*df.columns, F.col(rank).cast("bigint").alias(rank))


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of the table; every task keeps k rows at most."""
    return df.orderBy(*order_by).limit(k)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order_by: Sequence[Column], k: int,
    *, spread: int = 32, rank: str = "rank",
) -> DataFrame:
    """The k first rows of each group.

    ``row_number() <= k`` lets Spark cut each group before the shuffle. With
    many map tasks that still leaves k rows per task for a hot group, so the
    groups are first cut in ``spread`` salted parts.
    """
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in group] or df.columns), F.lit(spread))
    if spread > 1:
        parts = Window.partitionBy(*group, "_salt").orderBy(*order_by)
        df = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(parts))
              .where(F.col("_r") <= k).drop("_r", "_salt"))
    return (df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)))
            .where(F.col(rank) <= k))


def n_kept(n: Column, percent: float) -> Column:
    """max(1, round(n * percent / 100)) with ties to even."""
    return F.greatest(F.lit(1), F.rint(n * F.lit(float(percent)) / F.lit(100.0)).cast("bigint"))


def top_percent(
    df: DataFrame, percent: float, order_by: Sequence[Column], group: Sequence[str] = (),
    *, bounded_groups: bool = False, score: str | None = None,
) -> DataFrame:
    """Keep the best ``percent`` of each group, at least one row.

    ``bounded_groups`` says that a group fits one task (hits of one profile).
    ``score`` names a numeric column by which ``order_by`` begins, falling and
    with nulls last: the cut is then found by selection (``top_percent_by_score``).
    Otherwise the rank is computed over range partitions.
    """
    if score is not None and not bounded_groups:
        return top_percent_by_score(df, percent, score, order_by, group)
    if bounded_groups:
        ranked = rank_within(df, group, order_by, "_rank")
    else:
        ranked = global_rank(df, order_by, group, "_rank")
    sizes = ranked.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        ranked = ranked.join(sizes, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
        n = F.col("_n")
    else:
        n = sizes.select("_n").scalar()
    return ranked.where(F.col("_rank") <= n_kept(n, percent)).select(*df.columns)


#: Relative error of the sketches that bracket a cut: 1 / SKETCH of a group's rows.
SKETCH = 2_000


def _height(score: str) -> Column:
    """A number without gaps that falls as the order by falling score goes on: null is lowest, NaN is on top."""
    x = F.col(score).cast("double")
    return F.coalesce(F.when(F.isnan(x), float("inf")).otherwise(x), F.lit(float("-inf")))


def _per_group(table: DataFrame, group: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """One row per group with its key renamed, and the condition that joins it to the rows."""
    named = table.select(*[F.col(g).alias(f"_g_{g}") for g in group], *columns)
    return named, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]


def top_percent_by_score(
    df: DataFrame, percent: float, score: str, order_by: Sequence[Column], group: Sequence[str] = (),
) -> DataFrame:
    """The best ``percent`` of each group by selection: rows are not moved by group.

    Two narrow passes over (group, score) find the cut. The first counts every
    group and brackets its cut between two values of a percentile sketch; the
    second counts exactly what lies above and inside the bracket. Rows above it are
    kept where they are, rows below it are dropped, and only the rows inside, about
    4 in ``SKETCH`` of a group and the ties of its ends, are ranked, over range
    partitions. A bracket that misses the cut is opened to the whole group, so the
    result is exact whatever the sketch says. The table of brackets has one row per
    group; it is broadcast when it is small. ``df`` is read four times: store it
    first if it is dear to compute.
    """
    if not group:  # one group for all, so that what is joined has a key
        whole = df.withColumn("_all", F.lit(1))
        return top_percent_by_score(whole, percent, score, order_by, ["_all"]).drop("_all")
    height = _height(score).alias("_height")
    share = percent / 100.0
    ends = [min(1.0, max(0.0, 1 - share + d / SKETCH)) for d in (2.0, -2.0)]
    narrow = df.select(*group, height)
    sketch = narrow.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_height", F.array(*[F.lit(e) for e in ends]), SKETCH).alias("_ends"))
    brackets = settle(sketch.select(*group, "_n", F.get("_ends", 0).alias("_high"), F.get("_ends", 1).alias("_low")))

    named, same = _per_group(brackets, group, ["_n", "_high", "_low"])
    counted = narrow.join(small_side(named), same).groupBy(*[f"_g_{g}" for g in group], "_n", "_high", "_low").agg(
        F.count_if(F.col("_height") > F.col("_high")).alias("_above"),
        F.count_if(F.col("_height") >= F.col("_low")).alias("_reached"))
    keep = n_kept(F.col("_n"), percent)
    held = (F.col("_above") <= keep) & (keep <= F.col("_reached"))
    infinite = F.lit(float("inf"))
    cuts = settle(counted.select(
        *[F.col(f"_g_{g}").alias(g) for g in group],
        F.when(held, F.col("_high")).otherwise(infinite).alias("_high"), F.when(held, F.col("_low")).otherwise(-infinite).alias("_low"),
        F.when(held, keep - F.col("_above")).otherwise(keep).alias("_rest")))
    named, same = _per_group(cuts, group, ["_high", "_low", "_rest"])
    placed = df.withColumn("_height", height).join(small_side(named), same)
    sure = placed.where(F.col("_height") > F.col("_high")).select(*df.columns)
    inside = placed.where((F.col("_height") <= F.col("_high")) & (F.col("_height") >= F.col("_low"))).select(*df.columns, "_rest")
    ranked = global_rank(inside, order_by, group, "_rank")
    return sure.unionByName(ranked.where(F.col("_rank") <= F.col("_rest")).select(*df.columns))


def final_order() -> list[Column]:
    return [F.desc_nulls_last("candidate_score"), F.desc_nulls_last("recruiter_score")]


def rescored_order() -> list[Column]:
    return [F.desc_nulls_last("recruiter_score"), F.desc_nulls_last("candidate_score")]
