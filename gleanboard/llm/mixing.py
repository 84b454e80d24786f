"""Mixing sources to target weights by entropy balancing.

Every source has a target of words. Document rates stay as close as they can, in
bounded relative entropy, to taking each document once, between 0 and a largest
rate, while the expected words of each source equal its target. The dual is
convex with one multiplier per source; its solution tilts the odds of a document
exponentially in its size. Newton's steps are aggregates over counted (source,
size) pairs; bisection bounds guard them. Rates become whole copies by
systematic rounding in order of size, so the words of a source stay within one
document of the target, and single copies are then moved to close what is left.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; sources without words have target 0; equal
sizes are ordered by a hash of the id, then the id; repeated rows count each; an
empty table gives an empty result; other columns are passed on by
``mixed_documents`` and not read.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

WEIGHTS = (5, 2, 1)
MOST = 3
NEWTON_STEPS = 60
REPAIRS = 6
#: Rates are whole multiples of this share, so that sums do not depend on their order.
GRAIN = 1 << 24


def size_of(text: Column) -> Column:
    """Words of a text; the words need no list of their own."""
    return F.when(text.isNull(), 0).otherwise(
        F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
        - F.when(text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(1)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words of each source: the whole shared by weight, none above ``most`` times its own."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]  # Python orders by code point
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    rest, free = float(sum(sizes.values())), list(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / whole for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def _rate(tilt: Column, size: Column, scale: Column, most: int) -> Column:
    """most / (1 + (most - 1) exp(-tilt size)): 1 without a tilt, between 0 and most."""
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / scale))))


def balance(counted: DataFrame, goal: dict, scale: dict, most: int = MOST, steps: int = NEWTON_STEPS) -> dict:
    """The multiplier of every source, from rows (source, size, n).

    Each step is one aggregate with a row per source; sums are exact decimals,
    so reruns agree. A source whose target is its largest possible amount gets
    an infinite multiplier, one with target 0 or no words none.
    """
    spark = counted.sparkSession
    tilt = {s: 0.0 for s in goal}
    low, high = {s: -math.inf for s in goal}, {s: math.inf for s in goal}
    live = {s for s in goal if goal[s] > 0}
    for _ in range(steps):
        if not live:
            break
        now = spark.createDataFrame([(s, float(tilt[s]), float(scale[s])) for s in sorted(live, key=str)], "source string, tilt double, scale double")
        rows = counted.join(F.broadcast(now), counted["source"].eqNullSafe(now["source"])).drop(now["source"])
        r = _rate(F.col("tilt"), F.col("size"), F.col("scale"), most)
        rows = rows.withColumn("r", r)
        exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
        sums = rows.groupBy("source").agg(
            exact(F.col("r") * F.col("size") * F.col("n")).alias("words"),
            exact(F.col("r") * (1 - F.col("r") / most) * F.col("size") * F.col("size") / F.col("scale") * F.col("n")).alias("slope")).collect()
        for row in sums:
            s, gap = row["source"], goal[row["source"]] - row["words"]
            if abs(gap) <= 1e-7 * max(1.0, goal[s]):
                live.discard(s)
                continue
            (low if gap > 0 else high)[s] = tilt[s]
            step = tilt[s] + max(-4.0, min(4.0, gap / row["slope"])) if row["slope"] > 1e-12 else math.inf
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else tilt[s] + math.copysign(4.0, gap)
            if step == tilt[s] or abs(step) > 600:
                live.discard(s)
            tilt[s] = step
    return {s: (math.inf if goal[s] > 0 and tilt[s] > 600 else round(tilt[s], 12)) for s in goal}


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, tag); tag is xxhash64 of the text."""
    spark = docs.sparkSession
    folder = scratch_path(spark, f"mixing-{uuid.uuid4().hex[:8]}")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("tag"))
    rows.write.parquet(f"{folder}/sizes")
    rows = spark.read.parquet(f"{folder}/sizes")
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    counted.write.parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    per = {r["source"]: r for r in counted.groupBy("source").agg(  # a row per source
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()}
    sizes = {s: r["words"] for s, r in per.items()}
    goal = targets(sizes, weights, most)
    goal_for = {s: (0.0 if not sizes[s] else goal[s]) for s in sizes}
    full = {s for s in sizes if sizes[s] and goal_for[s] >= most * sizes[s] * (1 - 1e-12)}
    scale = {s: max(1.0, sizes[s] / r["n"]) for s, r in per.items()}
    tilt = balance(counted, {s: g for s, g in goal_for.items() if s not in full}, scale, most)
    known = spark.createDataFrame(
        [(s, sizes[s], float(goal_for[s]), float(tilt.get(s, 0.0)), scale[s], s in full) for s in sizes] or [(None, 0, 0.0, 0.0, 1.0, False)],
        "source string, source_size long, target double, tilt double, scale double, full boolean")

    # Rates in whole grains; sorted by source and size in range partitions, summed up per partition.
    rate = F.when(F.col("full") | F.col("tilt").eqNullSafe(F.lit(math.inf)), most).otherwise(
        _rate(F.col("tilt"), F.col("size"), F.col("scale"), most))
    order = ["source", "size", "shuffled", "doc_id", "tag"]
    (rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["source"])).drop(known["source"])  # a row per source
     .withColumn("grains", F.when((F.col("size") == 0) | (F.col("target") == 0), 0).otherwise(F.round(rate * GRAIN)).cast("long"))
     .withColumn("shuffled", F.xxhash64("doc_id"))
     .select("doc_id", "source", "size", "tag", "source_size", "target", "grains", "shuffled")
     .repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/rates"))
    rates = spark.read.parquet(f"{folder}/rates")
    parts = rates.groupBy("source", "part").agg(F.sum("grains").alias("grains"))
    before = parts.select("source", "part", (F.sum("grains").over(
        W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("grains")).alias("before"))
    before = before.withColumnsRenamed({"source": "b_source", "part": "b_part"})
    placed = rates.join(F.broadcast(before), (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
    upto = F.col("before") + F.sum("grains").over(
        W.partitionBy("part", "source").orderBy("size", "shuffled", "doc_id", "tag").rowsBetween(W.unboundedPreceding, 0))
    half = GRAIN // 2
    whole = lambda g: F.floor((g + half) / GRAIN)
    copied = placed.withColumn("upto", upto).select(
        "doc_id", "source", "size", "tag", "source_size", "target", (F.col("grains") / GRAIN).alias("rate"),
        F.greatest(F.lit(0), F.least(F.lit(most), whole(F.col("upto")) - whole(F.col("upto") - F.col("grains")))).cast("long").alias("copies"),
        "shuffled", "part")
    copied.write.parquet(f"{folder}/copies")
    out = spark.read.parquet(f"{folder}/copies")
    moved: list[tuple] = []
    for _ in range(REPAIRS):
        more = _repair(out, moved, most)
        if not more:
            break
        moved += more
    return _with_moves(out, moved).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tag")


def _with_moves(out: DataFrame, moved: list[tuple]) -> DataFrame:
    """Applies single moved copies: at most one per source and repair."""
    if not moved:
        return out
    rows = out.sparkSession.createDataFrame(moved, "m_part int, m_doc long, m_tag long, m_source string, m_step long")
    same = (F.col("part") == F.col("m_part")) & F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("tag").eqNullSafe(F.col("m_tag")) & F.col("source").eqNullSafe(F.col("m_source"))
    return out.join(F.broadcast(rows), same, "left").withColumn("copies", F.col("copies") + F.coalesce("m_step", F.lit(0))).drop(
        "m_part", "m_doc", "m_tag", "m_source", "m_step")


def _repair(out: DataFrame, moved: list[tuple], most: int) -> list[tuple]:
    """For every source the one copy whose move brings its words nearest to the target, if any does.

    Rows that repeat id and text in one partition would move together, so they are left alone.
    """
    now = _with_moves(out, moved)
    gaps = {r["source"]: r["gap"] for r in now.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).collect()}
    wanted = [(s, float(g)) for s, g in gaps.items() if abs(g) >= 1]
    if not wanted:
        return []
    table = now.sparkSession.createDataFrame(wanted, "g_source string, gap double")
    rows = now.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("g_source"))).where(
        (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap"))
        & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0))
    done = {(m[0], m[1], m[2], m[3]) for m in moved}
    best = rows.groupBy("source").agg(F.min(F.struct(
        F.abs(F.abs("gap") - F.col("size")).alias("off"), "shuffled", "part", "doc_id", "tag", F.signum("gap").cast("long").alias("step"))).alias("b")).collect()
    found = [(r["b"]["part"], r["b"]["doc_id"], r["b"]["tag"], r["source"], r["b"]["step"]) for r in best]
    found = [m for m in found if m[:4] not in done]
    if found:
        t = now.sparkSession.createDataFrame([m[:4] for m in found], "m_part int, m_doc long, m_tag long, m_source string")
        same = (F.col("part") == F.col("m_part")) & F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("tag").eqNullSafe(F.col("m_tag")) & F.col("source").eqNullSafe(F.col("m_source"))
        twice = {(r["m_part"], r["m_doc"], r["m_tag"], r["m_source"]) for r in out.join(F.broadcast(t), same).groupBy(
            "m_part", "m_doc", "m_tag", "m_source").count().where("count > 1").collect()}
        found = [m for m in found if m[:4] not in twice]
    return found


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The documents, each as often as the mix takes it.

    Rows that repeat id, source and text share the copies of all of them as evenly as whole copies allow.
    """
    taken = mix(docs, doc_id, source, text, **how).groupBy(
        F.xxhash64("doc_id", "source", "tag").alias("_key")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    own = docs.withColumn("_row_key", F.xxhash64(F.col(doc_id).cast("long"), F.col(source), F.xxhash64(F.col(text))))
    joined = own.join(taken, F.col("_row_key") == F.col("_key"))
    alike = W.partitionBy("_row_key")
    rows, place = F.count("*").over(alike), F.row_number().over(alike.orderBy("_row_key"))
    share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_place") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    times = joined.withColumns({"_rows": rows, "_place": place}).withColumn("_times", share.cast("int")).where("_times > 0")
    return times.withColumn("_n", F.explode(F.sequence(F.lit(1), "_times"))).select(*[F.col(f"`{c}`") for c in docs.columns])
