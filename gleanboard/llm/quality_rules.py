"""Quality rules: text statistics and a learned decision list, in column expressions only.

A decision list is learned by sequential covering: rules for bad documents are
grown one threshold condition at a time by information gain on one half of the
labelled statistics, pruned on the other half, kept while precise, and the
documents they cover are taken out before the next rule. The list is emitted as
one ordered conditional expression, so applying it needs no shuffle and no
Python.

Defined results: null text counts as empty; documents without a label, or with
a null label, are only judged, never learned from; with no labels at all the
list is empty and only the base rule decides; very long texts are read whole
(the repeat count sorts, so it grows as n log n).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Labelled rows that are learned from, at most about this many (drawn by a hash of the id).
LABELLED_ROWS = 20_000
FEATURES = ["n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "line_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))
    return F.coalesce(windows, F.array().cast("array<struct<h:bigint,p:int>>"))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of FEATURES."""
    full = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        "_words": F.filter(F.split(full, SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(full, "\n"), lambda s: s.rlike(NOT_SPACE)),
        "_chars": F.char_length(full),
        "n_symbols": (F.char_length(full) - F.char_length(F.regexp_replace(full, SYMBOLS, ""))).cast("long")})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.sort_array(_repeat_words(F.col("_words")))}).drop("_words", "_lines")
    twice = F.transform("_windows", lambda x, i: F.when(
        (F.get("_windows", i - 1)["h"] == x["h"]) | (F.get("_windows", i + 1)["h"] == x["h"]), x["p"]))
    # A filter on the results must not move below this step, or it would repeat the work for every word.
    df = df.withColumn("_starts", F.when(F.monotonically_increasing_id() >= 0, F.sort_array(
        F.filter(twice, lambda p: p.isNotNull())))).drop("_windows")
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0), lambda n, x: n + x)
    df = df.withColumn("n_repeat_words", covered.cast("long")).drop("_starts")
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return df.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "_chars"),
        "dup_line_ratio": share("n_dup_lines", "_n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"),
        "line_words": share("n_words", "_n_lines")}).drop("_chars", "_n_lines")


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (feature, at_most, threshold)."""

    conditions: list[tuple[str, bool, float]]
    precision: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, limit in self.conditions:
            out &= (F.col(name) <= limit) if at_most else (F.col(name) > limit)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if m else '>'} {t:g}" for n, m, t in self.conditions)


@dataclass
class DecisionList:
    """Rules for bad documents in the order they are asked; no match keeps."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that matches, from 1; null if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
        return F.lit(None).cast("int") if out is None else out

    def keeps(self) -> Column:
        return self.fired().isNull()


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
             rows: int = LABELLED_ROWS) -> DataFrame:
    """Documents with a label; of more than ``rows`` labels a share is drawn by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("_label"))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    known = known.where(F.pmod(F.xxhash64(F.col(doc_id), F.lit("labelled")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(F.broadcast(known), doc_id)  # bounded by rows


def learn(stats: DataFrame, doc_id: str = "doc_id", label: str = "_label", features: list[str] | None = None,
          among: Column | None = None, max_rules: int = 8, max_conditions: int = 3, bins: int = 32, min_cover: int = 8,
          precision: float = 0.9) -> DecisionList:
    """Sequential covering over labelled statistics (label 0 is bad), of rows that hold ``among``.

    Spark bins every feature at its exact quantiles and counts equal rows; the
    covering works on these counts, of which there are no more than labelled rows.
    """
    names = FEATURES if features is None else features
    points = [i / bins for i in range(1, bins)]
    stats = stats.select(F.xxhash64(F.col(doc_id), F.lit("half")).alias("_h"), (F.col(label) == 0).alias("_bad"),
                         (F.lit(True) if among is None else among).alias("_use"),
                         *(F.col(n).cast("double").alias(n) for n in names))
    stats = settle(stats).where("_use")  # a few numbers of each labelled row, read more than once
    edges = stats.agg(*(F.percentile(n, points).alias(n) for n in names)).head()
    cuts = {n: sorted({e for e in (edges[n] or []) if e is not None}) for n in names}
    bin_of = lambda n: F.aggregate(
        F.array(*map(F.lit, cuts[n])), F.lit(0), lambda k, e: k + F.when(F.col(n) > e, 1).otherwise(0)) if cuts[n] else F.lit(0)
    counted = (stats.select((F.pmod("_h", F.lit(3)) > 0).alias("_grow"), "_bad", *(bin_of(n).alias(n) for n in names))
               .groupBy("_grow", "_bad", *names).count().collect())
    cells = sorted((tuple(r[n] for n in names), r["_bad"], r["count"], r["_grow"]) for r in counted)
    grow, prune = [c[:3] for c in cells if c[3]], [c[:3] for c in cells if not c[3]]
    found = []
    while len(found) < max_rules:
        terms = _grow(grow, cuts, names, max_conditions, min_cover)
        terms = _prune(terms, prune)
        good = terms and _precision(terms, prune)
        if not terms or good[0] < precision or good[1] < min_cover / 2 or _precision(terms, grow)[0] < precision:
            break
        found.append(Rule([(names[f], at_most, cuts[names[f]][k]) for f, at_most, k in terms], round(good[0], 4)))
        grow = [c for c in grow if not _covers(terms, c[0])]
        prune = [c for c in prune if not _covers(terms, c[0])]
    return DecisionList([_centre(r, stats) for r in found])


def _centre(rule: Rule, stats: DataFrame) -> Rule:
    """Moves every threshold half way from the last good bin to the bad documents that it covers."""
    bad = stats.where(rule.column() & F.col("_bad")).agg(*(
        F.percentile(n, 0.98 if at_most else 0.02).alias(str(i)) for i, (n, at_most, _) in enumerate(rule.conditions))).head()
    return Rule([(n, m, t if bad[i] is None else (t + bad[i]) / 2) for i, (n, m, t) in enumerate(rule.conditions)], rule.precision)


def _covers(terms, cell) -> bool:
    return all(cell[f] <= k if at_most else cell[f] > k for f, at_most, k in terms)


def _counts(cells) -> tuple[int, int]:
    return sum(n for _, bad, n in cells if bad), sum(n for _, bad, n in cells if not bad)


def _precision(terms, cells) -> tuple[float, int]:
    bad, good = _counts([c for c in cells if _covers(terms, c[0])])
    return bad / max(bad + good, 1), bad


def _grow(cells, cuts, names, max_conditions, min_cover):
    """Adds the condition of the highest gain until only bad cells are covered."""
    terms: list[tuple[int, bool, int]] = []
    bad, good = _counts(cells)
    while good and bad and len(terms) < max_conditions:
        base, best = math.log2(bad / (bad + good)), (1e-9, None, 0, 0)
        for f, name in enumerate(names):
            width = len(cuts[name])
            seen = [[0, 0] for _ in range(width + 1)]
            for cell, is_bad, n in cells:
                seen[cell[f]][not is_bad] += n
            low = [0, 0]
            for k in range(width):
                low = [low[0] + seen[k][0], low[1] + seen[k][1]]
                for at_most, (b, g) in ((True, low), (False, (bad - low[0], good - low[1]))):
                    if b >= min_cover:
                        gain = b * (math.log2(b / (b + g)) - base)
                        if gain > best[0]:
                            best = (gain, (f, at_most, k), b, g)
        if best[1] is None:
            break
        terms.append(best[1])
        cells = [c for c in cells if _covers([best[1]], c[0])]
        bad, good = best[2], best[3]
    return terms


def _prune(terms, cells):
    """Drops last conditions while (bad - good) / covered on the pruning half does not fall."""
    def worth(some):
        bad, good = _counts([c for c in cells if _covers(some, c[0])])
        return (bad - good) / max(bad + good, 1)

    best = list(terms)
    while len(best) > 1 and worth(best[:-1]) >= worth(best):
        best = best[:-1]
    return best
