"""Scores as plain arithmetic over verdict columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Default weights.
CANDIDATE_WEIGHTS = {"must_haves_met": 20, "must_haves_missing": -10,
                     "themes_matched": 5, "disqualifiers_triggered": -15}
RECRUITER_WEIGHTS = {"technical_match": 0.35, "seniority_match": 0.35, "transferability": 0.1,
                     "trajectory": 0.1, "soft_skills": 0.1}


def recruiter_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the 0-10 ratings on a 0-100 scale, ties to even.

    Terms are added in the order of the weights and in double precision, so
    the result does not depend on the engine's order of evaluation.
    """
    weights = RECRUITER_WEIGHTS if weights is None else weights
    top = 10 * sum(weights.values())
    if not top:
        return F.lit(0)
    terms = [F.lit(float(w)) * F.coalesce(F.col(name), F.lit(0)) for name, w in weights.items()]
    return F.rint(F.lit(100.0) * reduce(lambda a, b: a + b, terms) / F.lit(float(top))).cast("int")


def candidate_score(weights: dict[str, float] | None = None) -> Column:
    """Sum of weight times list length; a missing list counts as empty."""
    weights = CANDIDATE_WEIGHTS if weights is None else weights
    terms = [F.lit(w) * F.coalesce(F.when(F.col(n).isNotNull(), F.size(n)), F.lit(0))
             for n, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in parts]) / F.lit(float(total))


def rescaled(value: Column, low: Column, high: Column) -> Column:
    """Linear map of [low, high] to [0, 1]; a zero range gives 0."""
    span = (high - low).cast("double")
    return F.when(span == 0, F.lit(0.0)).otherwise((value - low) / span)
