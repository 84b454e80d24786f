import random

import pytest
from pyspark.sql import functions as F

from gleanboard.operators.dedupe import (duplicate_report, first_spellings, keep_first, keep_first_of_queries,
                                         merge_across_sources, require_unique_key, with_keys)

SCHEMA = ("n int, employer_name string, title string, city string, platform_url string, "
          "source_platform string, actor string")


def brute_force(rows):
    """The rule row by row: keyed groups first, blanks alone."""
    def norm(v):
        return None if v is None else " ".join(v.lower().split())

    groups, alone = {}, []
    for r in sorted(rows):
        key = tuple(norm(v) for v in (r[1], r[2], r[3]))
        source = r[5] or r[6]
        if all(key):
            groups.setdefault(key, [r, set()])[1].add(source)
        else:
            alone.append((r[0], (source,)))
    return sorted([(r[0], tuple(sorted(s))) for r, s in groups.values()] + alone)


def random_rows(n, seed):
    pick = random.Random(seed)
    return [(i, pick.choice(["Acme GmbH", "acme  gmbh ", "Beta", None]), pick.choice(["Dev", " dev", "Ops", ""]),
             pick.choice(["Ulm", "ULM", "", None]), f"u{i}", pick.choice(["A", "B", "", None]), "z") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_brute_force(spark, seed):
    rows = random_rows(200, seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r["n"], tuple(r["found_on"])) for r in merge_across_sources(df, ["n"]).collect())
    assert got == brute_force(rows)


def test_merge_is_idempotent_and_drops_transient_columns(spark):
    df = spark.createDataFrame(random_rows(100, 7), SCHEMA)
    once = merge_across_sources(df, ["n"])
    assert not {"actor", "source_platform"} & set(once.columns)
    again = once.withColumn("source_platform", F.col("found_on")[0]).withColumn("actor", F.lit("z")).drop("found_on")
    assert merge_across_sources(again, ["n"]).count() == once.count()


def test_equal_blank_rows_are_all_kept(spark):
    row = (1, "Acme", "Dev", None, "u", "A", "z")
    df = spark.createDataFrame([row] * 5, SCHEMA)
    assert merge_across_sources(df, ["n"]).count() == 5


def test_hot_job_and_hot_blank(spark):
    """A third of all rows on one job, a third without a city."""
    df = spark.range(30_000).select(
        F.col("id").cast("int").alias("n"), F.lit("Acme").alias("employer_name"),
        F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("Job "), "id")).alias("title"),
        F.when(F.col("id") % 3 != 1, "Ulm").alias("city"), F.lit("u").alias("platform_url"),
        F.concat(F.lit("S"), F.col("id") % 4).alias("source_platform"), F.lit("z").alias("actor"))
    out = merge_across_sources(df, ["n"])
    assert out.count() == 20_001
    hot = out.where("title = 'Hot'").first()
    assert hot["n"] == 0 and hot["found_on"] == ["S0", "S1", "S2", "S3"]


def test_keep_first_treats_nulls_as_equal_and_compares_raw(spark):
    df = spark.createDataFrame([(2, "Acme", "Dev", None), (1, "Acme", "Dev", None), (3, "acme", "Dev", None)],
                               "n int, employer_name string, title string, city string")
    assert sorted(r["n"] for r in keep_first(df, ["n"]).collect()) == [1, 3]
    assert keep_first(df.select("n"), ["n"]).count() == 3  # no key column: rows pass through


def test_earlier_query_wins_and_provenance_can_be_merged(spark):
    df = spark.createDataFrame(
        [(1, "b", "B b", 5, "E", "T", "C", ["X"]), (0, "a", "A a", 9, "E", "T", "C", ["Y"])],
        "query_ord int, search_label string, search_query string, n int, employer_name string, title string, "
        "city string, found_on array<string>")
    plain = keep_first_of_queries(df, ["n"]).collect()
    assert [(r["n"], r["found_on"]) for r in plain] == [(9, ["Y"])]
    merged = keep_first_of_queries(df, ["n"], merge_found_on=True)
    assert merged.first()["found_on"] == ["X", "Y"] and "search_label" not in merged.columns


def test_key_gate(spark):
    df = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "v")], "key string, title string")
    with pytest.raises(ValueError, match="2 rows"):
        require_unique_key(df)
    assert duplicate_report(df).count() == 2
    assert require_unique_key(df.where("title <> 'u'")).count() == 2
    with pytest.raises(ValueError, match="no 'key'"):
        require_unique_key(df.drop("key"))


def test_match_key_is_stable_when_a_source_is_added(spark):
    rows = [(1, "Acme", "Dev", "Ulm", "u", "A", "z"), (2, "ACME", "dev", "ulm", "v", "B", "z")]
    one = with_keys(merge_across_sources(spark.createDataFrame(rows[:1], SCHEMA), ["n"])).first()
    two = with_keys(merge_across_sources(spark.createDataFrame(rows, SCHEMA), ["n"])).first()
    assert one["match_key"] == two["match_key"] and one["key"] != two["key"]


def test_first_spellings(spark):
    df = spark.createDataFrame([(0, " Data "), (1, "data"), (2, None), (3, "  "), (4, "Ops")], "i int, v string")
    assert sorted((r["i"], r["v"]) for r in first_spellings(df, "v", ["i"]).collect()) == [(0, "Data"), (4, "Ops")]


def test_match_form_and_blanks_of_odd_texts(spark):
    from pyspark.sql import functions as F

    from gleanboard.functions.text import match_text, squeeze
    from gleanboard.operators.dedupe import has_match_parts

    odd = ["", " ", "   ", "a", "  A   b ", "\t", "\x1c", "  　 ", " x", "É  TÉ\t\n x", "\x7f", " ", "​", "a\x1f\x1fb", None]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(
        match_text(F.col("t")).alias("new"), F.trim(squeeze(F.lower("t"))).alias("old"), has_match_parts(["t"]).alias("part")).collect()
    assert all(r["new"] == r["old"] and r["part"] == bool(r["old"]) for r in got)


def test_wide_rows_stay_where_they_are_while_winners_are_few(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(random_rows(200, 3), SCHEMA).withColumn("description", F.repeat(F.lit("d"), 50))
    out = merge_across_sources(df, ["n"], counted=True)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert sorted(map(str, out.collect())) == sorted(map(str, merge_across_sources(df, ["n"]).collect()))


def test_a_stored_portfolio_reads_its_table_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from gleanboard.plans.collect import run_portfolio, store_portfolio

    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(random_rows(120, 4), SCHEMA).withColumn("description", F.lit("")).repartition(2)

    @F.udf("int")
    def seen(n):
        read.add(1)
        return n

    queries = ["dev", "ops", " "]
    unique, per_query = run_portfolio(df, queries, ["n"])
    stored, summary = store_portfolio(df.withColumn("m", seen.asNondeterministic()("n")), queries, str(tmp_path), ["n"])
    assert read.value == 120
    counts = {r["label"]: r["rows"] for r in summary.collect()}
    assert counts["unique total"] == unique.count() == stored.count() and counts["hit total"] == per_query.count()
