import pytest
from pyspark.sql import Window, functions as F

from gleanboard.operators import ranking
from gleanboard.operators.ranking import global_rank, top_k_per_group, top_percent


@pytest.fixture(scope="module")
def table(spark):
    """Many ties, and one group with most of the rows."""
    return spark.range(5_000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 5).alias("score")).repartition(6)


def test_global_rank_equals_one_big_window(table):
    order = [F.desc("score"), F.asc("id")]
    wanted = table.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    got = global_rank(table, order)
    assert got.exceptAll(wanted.select(*got.columns)).isEmpty() and got.count() == 5_000


def test_global_rank_per_group_also_with_a_null_group(table):
    df = table.withColumn("g", F.nullif(F.col("g"), F.lit("g1")))
    order = [F.desc("score"), F.asc("id")]
    wanted = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    got = global_rank(df, order, ["g"])
    assert got.exceptAll(wanted.select(*got.columns)).isEmpty() and got.count() == 5_000


@pytest.mark.parametrize("bounded", [True, False])
def test_percent_cut(spark, bounded):
    sizes = {1: 1, 3: 2, 5: 2, 7: 4, 9: 4, 10: 5}  # half of n, ties to even
    df = spark.createDataFrame([(n, i, 1) for n in sizes for i in range(n)], "p int, id int, score int")
    out = top_percent(df, 50, [F.desc("score"), F.asc("id")], ["p"], bounded_groups=bounded)
    got = sorted((r["p"], r["id"]) for r in out.collect())
    assert got == [(n, i) for n, kept in sizes.items() for i in range(kept)]  # equal scores keep their order


def test_percent_cut_of_a_whole_table(spark):
    df = spark.range(10).withColumn("score", F.lit(1))
    assert sorted(r["id"] for r in top_percent(df, 30, [F.desc("score"), F.asc("id")]).collect()) == [0, 1, 2]
    assert top_percent(df, 1, [F.desc("score"), F.asc("id")]).count() == 1


def test_percent_cut_of_nothing(spark):
    df = spark.range(0).select("id", F.lit(1).alias("score"))
    assert top_percent(df, 30, [F.desc("score")]).count() == 0


def test_top_k_per_group_with_a_hot_group(table):
    order = [F.desc("score"), F.asc("id")]
    got = top_k_per_group(table, ["g"], order, 7)
    wanted = table.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where("rank <= 7")
    assert got.exceptAll(wanted.select(*got.columns)).isEmpty() and got.count() == wanted.count()


def windowed_cut(df, percent, order, group):
    """The cut by one window per group."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", n)
    return ranked.where(F.col("_r") <= ranking.n_kept(F.col("_n"), percent)).select(*df.columns)


@pytest.mark.parametrize("kind,percent,sketch", [("few", 30, 2_000), ("many", 3, 2_000), ("many", 50, 10), ("one", 0.01, 10),
                                                 ("odd", 99.9, 2_000), ("odd", 60, 10), ("few", 100, 10)])
def test_selection_equals_a_window(spark, monkeypatch, kind, percent, sketch):
    monkeypatch.setattr(ranking, "SKETCH", sketch)
    i = F.col("id")
    score = {"few": i % 5, "many": F.xxhash64("id") / 7.0, "one": F.lit(1),
             "odd": F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, float("nan")).when(i % 4 == 2, float("inf")).otherwise(-i)}[kind]
    df = spark.range(3_000).select(
        "id", F.when(i % 10 < 8, "hot").when(i % 10 == 8, F.concat(F.lit("g"), i % 700)).alias("g"), score.alias("score")).repartition(5)
    order = [F.desc_nulls_last("score"), F.asc("id")]
    got, wanted = top_percent(df, percent, order, ["g"], score="score"), windowed_cut(df, percent, order, ["g"])
    assert got.count() == wanted.count() and got.select("id").exceptAll(wanted.select("id")).isEmpty()


def test_selection_without_a_group_and_of_nothing(spark):
    df = spark.range(10).withColumn("score", F.lit(1))
    order = [F.desc("score"), F.asc("id")]
    assert sorted(r["id"] for r in top_percent(df, 30, order, score="score").collect()) == [0, 1, 2]
    assert top_percent(df.limit(0), 30, order, score="score").count() == 0
    assert top_percent(df.limit(0), 30, order, ["id"], score="score").columns == ["id", "score"]
