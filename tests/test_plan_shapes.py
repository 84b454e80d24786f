"""The plans that must hold at scale."""

import re

from pyspark.sql import functions as F

from gleanboard.checks import QUERIES
from gleanboard.checks.inputs import ORDER, doc_postings, label_queries, listings, vector_index
from gleanboard.checks.registry import Inputs
from gleanboard.operators import filters, nearest, ranking
from gleanboard.operators.dedupe import keep_first, merge_across_sources

SF = "/root/testdata/sf0.001"
EXPRESSIONS_IN_PYTHON = {"h1_strip_html", "h2_strip_html_if_tagged"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"\bExchange (?:hash|range|Round)", text))


def wide_moves(text, column="description"):
    """Exchanges whose rows hold the given column."""
    out, lines = 0, text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\b(?:Exchange|BroadcastExchange)\b", line):
            below = next((x for x in lines[i + 1:] if re.search(r"Project|Aggregate|Scan|Filter", x)), "")
            out += f"{column}#" in below.split("Batched")[0]
    return out


def test_dedupe_groups_narrow_rows_and_moves_wide_ones_once(spark):
    df = listings(Inputs(spark, SF)).checkpoint()
    for out in (merge_across_sources(df, ORDER), keep_first(df, ORDER)):
        text = plan(out)
        assert "partial_" in text and "CartesianProduct" not in text
        grouped = [line for line in text.splitlines() if "Aggregate(" in line]
        assert grouped and not any("description" in line for line in grouped)
        assert wide_moves(text) <= 1


def test_single_query_uses_the_built_in_top_k(spark):
    index = vector_index(Inputs(spark, SF))
    assert "TakeOrderedAndProject" in plan(nearest.search_one(index, [0.1] * 64, 5))


def test_many_queries_cut_before_the_shuffle(spark):
    t = Inputs(spark, SF)
    text = plan(nearest.search(vector_index(t), label_queries(t), 5))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_registered_query_joins_without_a_key(spark):
    for name, query in QUERIES.items():
        if name[:3] in ("b18", "b20", "c2_", "c5_", "c6_", "d1_", "d7_", "g4_"):
            text = plan(query(spark, SF))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_expressions_stay_in_the_jvm(spark):
    for name, query in QUERIES.items():
        if name.startswith("h") and name not in {*EXPRESSIONS_IN_PYTHON, "h35_failed_verdicts"}:
            assert "EvalPython" not in plan(query(spark, SF)), name


def test_filters_reach_the_scan(spark):
    t = Inputs(spark, SF)
    df = t.events.withColumn("posted_at", F.to_date("ts"))
    text = plan(filters.metadata_filter(t.documents.withColumnRenamed("lang", "city"), city="en"))
    assert "EqualTo(lang,en)" in text
    assert "ReadSchema: struct<event_id:bigint>" in plan(df.select("event_id"))


def test_ranking_does_not_sort_a_table_in_one_task(spark):
    df = spark.range(100).withColumn("score", F.col("id") % 3)
    out = ranking.global_rank(df, [F.desc("score"), F.asc("id")])
    text = plan(out)
    # The only single-task window runs over one count per partition.
    assert text.count("Exchange SinglePartition") <= 1
    assert "_rows" in text[text.index("Exchange SinglePartition"):] if "Exchange SinglePartition" in text else True


def test_few_hits_do_not_shuffle_the_postings(spark):
    from gleanboard.operators import joins

    t = Inputs(spark, SF)
    hits = nearest.search(vector_index(t), label_queries(t), 5).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = plan(joins.postings_of(hits, doc_postings(t)))
        many = plan(doc_postings(t).join(joins.small_side(hits.select("key"), rows=3), "key", "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles(few) == 0 and "BroadcastHashJoin" in few
    assert "SortMergeJoin" in many or "ShuffledHashJoin" in many


def test_a_percent_cut_does_not_move_rows_by_group(spark):
    t = Inputs(spark, SF)
    rows = doc_postings(t).select("key", "description", "lang", F.col("n_chars").alias("score"))
    text = plan(ranking.top_percent(rows, 30, [F.desc("score"), F.asc("key")], ["lang"], score="score"))
    assert wide_moves(text) == 0 and "CartesianProduct" not in text
