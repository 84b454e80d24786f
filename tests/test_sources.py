import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleanboard.plans import collect
from gleanboard.schemas import POSTING, POSTING_DEDUPED
from gleanboard.sources import tables
from gleanboard.sources.boards import BOARDS, read_board

NOW = dt.datetime(2026, 5, 20, 12)


def land(path, items):
    path.write_text("\n".join(json.dumps(i) for i in items))
    return str(path)


@pytest.mark.parametrize("name", sorted(BOARDS))
def test_empty_landing_gives_the_fixed_schema(spark, tmp_path, name):
    df = read_board(spark, name, land(tmp_path / "x.json", []), NOW)
    assert [(f.name, f.dataType) for f in df.schema][:13] == [(f.name, f.dataType) for f in POSTING]
    assert df.count() == 0


def test_alljobs_item(spark, tmp_path):
    item = {"platform_url": "u", "official_url": "", "title": "Dev", "company_name": "Acme", "platform": "Indeed",
            "location": {"raw": "Ulm, Deutschland"}, "posted_date": 1747000000000, "review_count": 7,
            "company_rating": 4.5, "description": "<p>a &uuml;</p>"}
    row = read_board(spark, "alljobs", land(tmp_path / "x.json", [item]), NOW).first()
    assert (row["job_url"], row["city"], row["country"], row["posted_at"], row["description"]) == \
        ("u", "Ulm", "Germany", dt.date(2025, 5, 11), "a ü")
    assert json.loads(row["raw"]) == item


def test_arbeitnow_keeps_remote_only(spark, tmp_path):
    items = [{"slug": "1", "remote": True}, {"slug": "2", "tags": ["Remote"]}, {"slug": "3", "remote": False},
             {"slug": "4", "tags": [], "remote": None}]
    df = read_board(spark, "arbeitnow", land(tmp_path / "x.json", items), NOW)
    assert sorted(json.loads(r["raw"])["slug"] for r in df.collect()) == ["1", "2"]


def test_weworkremotely_list_or_scalar(spark, tmp_path):
    items = [{"id": "1", "applicantCountries": ["USA", "X"]}, {"id": "2", "applicantCountries": "Europe"},
             {"id": "3", "companyHq": "Ulm, Germany"}, {"id": "4", "companyHq": "Ulm"}, {"id": "5", "type": "job_wwr_blocked"}]
    df = read_board(spark, "weworkremotely", land(tmp_path / "x.json", items), NOW)
    got = {json.loads(r["raw"])["id"]: (r["country"], r["city"]) for r in df.collect()}
    assert got == {"1": ("USA", ""), "2": ("Europe", ""), "3": ("Germany", "Ulm"), "4": ("", "Ulm")}


def test_a_failing_source_is_skipped_and_an_unknown_one_is_an_error(spark, tmp_path):
    good = land(tmp_path / "x.json", [{"url": "u", "title": "Dev", "company": "Acme", "location": "Ulm"}])
    frames, failed = collect.read_sources(spark, {"xing": good, "remotive": str(tmp_path / "nothing")}, NOW)
    assert list(frames) == ["xing"] and list(failed) == ["remotive"]
    row = collect.collect_postings(frames).first()
    assert row["found_on"] == ["Xing"] and len(row["key"]) == 32
    assert collect.collect_postings({}, spark).count() == 0
    with pytest.raises(ValueError, match="unknown source"):
        collect.read_sources(spark, {"nowhere": good}, NOW)


def test_first_source_wins(spark, tmp_path):
    xing = land(tmp_path / "x.json", [{"url": "x", "title": "Dev", "company": "Acme", "location": "Ulm"}])
    every = land(tmp_path / "a.json", [{"platform_url": "a", "title": "dev", "company_name": "ACME", "location": "ulm, Germany",
                                        "platform": "LinkedIn"}])
    frames, _ = collect.read_sources(spark, {"alljobs": every, "xing": xing}, NOW)
    row = collect.collect_postings(frames).first()
    assert row["platform_url"] == "a" and row["found_on"] == ["LinkedIn", "Xing"]


def test_required_search_fields():
    with pytest.raises(ValueError):
        collect.require_search("", "de")
    with pytest.raises(ValueError):
        collect.require_search("dev", "")
    assert collect.clean_queries([" A ", None, "a", "", "b"]) == ["A", "b"]


def test_portfolio_needs_a_query(spark):
    with pytest.raises(ValueError, match="at least one query"):
        collect.run_portfolio(spark.createDataFrame([], POSTING), [" ", None])


def test_reading_postings_adds_missing_columns(spark, tmp_path):
    spark.createDataFrame([("k", "t", 1)], "key string, title string, extra int").write.parquet(str(tmp_path / "p"))
    df = tables.read_postings(spark, str(tmp_path / "p"))
    assert set(POSTING_DEDUPED.names) <= set(df.columns) and "extra" in df.columns


def test_profiles(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"role_themes": ["x", "y"], "must_have_themes": "one",\n "search_query": "q"}')
    (tmp_path / "p" / "b.json").write_text("")
    rows = {r["profile_id"]: r for r in tables.read_profiles(spark, str(tmp_path / "p")).collect()}
    assert rows["a.json"]["role_themes"] == ["x", "y"] and rows["a.json"]["must_have_themes"] == ["one"]
    (tmp_path / "p" / "c.json").write_text("[1]")
    with pytest.raises(Exception, match="a profile is a JSON object"):
        tables.read_profiles(spark, str(tmp_path / "p")).collect()


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for day in (1, 3, 2):
        tables.register_run(spark, path, f"r{day}", dt.datetime(2026, 5, day), {"top_n": 5})
    tables.register_run(spark, "", "off", NOW, {})
    assert [r["run_id"] for r in tables.recent_runs(spark, path, 2).collect()] == ["r3", "r2"]
    assert tables.run_id("Qwen3:27b", 200, 30, dt.datetime(2026, 5, 20, 1, 2, 3)) == "qwen3-27b__n200__keep30__20260520-010203"
    with pytest.warns(UserWarning, match="nothing is stored"):
        assert tables.previous_run(spark, str(tmp_path / "none"), "r9") is None
    assert tables.previous_run(spark, path, None, "") is None


def test_landed_order_does_not_depend_on_splits(spark, tmp_path):
    import datetime as dt
    import json

    from gleanboard.sources.boards import read_board
    now = dt.datetime(2026, 5, 20, tzinfo=dt.timezone.utc)
    for name, n in (("a", 3), ("b", 400), ("c", 30)):
        (tmp_path / f"{name}.jsonl").write_text("".join(
            json.dumps({"id": k, "url": f"u{name}{k}", "title": f"{name}{k:04d}", "company_name": "x", "description": "d" * 200}) + "\n" for k in range(n)))
    want = [f"{name}{k:04d}" for name, n in (("a", 3), ("b", 400), ("c", 30)) for k in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = read_board(spark, "remotive", str(tmp_path), now).orderBy("row_ord").select("title").collect()
            assert [r["title"] for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_run_ids_of_a_table_equal_those_of_a_call(spark):
    now = dt.datetime(2026, 5, 20, 1, 2, 3)
    rows = [("Qwen/3.5:9b!", 200, 30.0), ("--", 1, 12.5), ("a", 10, 100.0), ("B b", 0, 0.25), ("x9", 7, 33.333)]
    df = spark.createDataFrame([(*r, now) for r in rows], "m string, n int, k double, t timestamp")
    got = df.select(tables.run_id_column(F.col("m"), F.col("n"), F.col("k"), F.col("t")).alias("id")).collect()
    assert [r["id"] for r in got] == [tables.run_id(*r, now) for r in rows]
