import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from gleanboard.functions import dates, keys, places, scores, text, vectors, verdicts

NOW = dt.datetime(2026, 5, 20, 12, tzinfo=dt.timezone.utc)


def test_strip_html(column_of):
    cases = {"<p>A&amp;B</p>  C": "A&B C", "&lt;b&gt;": "<b>", None: "", "a&nbsp;&nbsp;b": "a b",
             "f&uuml;r &#8364;5 &copy": "für €5 ©", "&amp;lt;": "&lt;", "<script>x</script>": "x", "a \n b": "a b"}
    assert column_of(text.strip_html, *cases) == list(cases.values())


def test_strip_html_only_if_tagged(column_of):
    assert column_of(text.strip_html_if_tagged, "R&amp;D  x", "<b>R&amp;D</b>", None) == ["R&amp;D  x", "R&D", None]


def test_match_text(column_of):
    assert column_of(text.match_text, "  Acme\t GmbH ", "A  B", None, "  ") == ["acme gmbh", "a b", None, ""]


def test_names(column_of):
    assert column_of(text.slug, "A--b c!", "!!!", "x") == ["a-b-c", "x", "x"]
    assert column_of(text.file_safe, "Ä b/c__", None, "...", "x" * 80) == ["b_c", "untitled", "...", "x" * 60]
    assert column_of(text.query_label, " Data  Scientist ", "", None) == ["data_scientist", "query", "query"]
    assert column_of(lambda c: text.form_int(c, 20), " 7 ", "", None, "x") == [7, 20, 20, 20]


def test_posted_at(column_of):
    d = dt.date
    cases = {
        "3 days ago": d(2026, 5, 17), "2 months ago": d(2026, 3, 21), "Yesterday": d(2026, 5, 19), "Just now": d(2026, 5, 20),
        "1747000000": d(2025, 5, 11), "1747000000000": d(2025, 5, 11), "20260510": d(1970, 8, 23), "30+ days ago": None,
        "": None, "2026-05-10T14:23:00Z": d(2026, 5, 10), "2026-05-10": d(2026, 5, 10), "an hour ago": None,
        "Posted 1 year ago": d(2025, 5, 20), "2026-05-10T23:30:00-05:00": d(2026, 5, 11), "May 3, 2026": d(2026, 5, 3),
        "rubbish": None, None: None, "9" * 30: None, "99999999999 years ago": None, "-86400": d(1969, 12, 31)}
    assert column_of(lambda c: dates.parse_posted_at(c, NOW), *cases) == list(cases.values())


def test_posted_at_needs_the_time_of_day(column_of):
    early = dt.datetime(2026, 5, 20, 1)
    assert column_of(lambda c: dates.parse_posted_at(c, early), "2 hours ago") == [dt.date(2026, 5, 19)]


def test_posted_at_ignores_session_time_zone(spark, column_of):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        cases = {"2026-05-10T01:00:00Z": dt.date(2026, 5, 10), "2026-05-10T01:00:00": dt.date(2026, 5, 10),
                 "today": dt.date(2026, 5, 20), "5/10/2026": dt.date(2026, 5, 10)}
        assert column_of(lambda c: dates.parse_posted_at(c, NOW), *cases) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cutoffs():
    assert dates.recency_cutoff("7 days ago", NOW) == dt.date(2026, 5, 13)
    for bad in ("7", "7 days", "long ago"):
        with pytest.raises(ValueError):
            dates.recency_cutoff(bad, NOW)
    assert dates.posted_since_cutoff("14", NOW) == dt.date(2026, 5, 6)
    assert dates.posted_since_cutoff("6 months", NOW) == dt.date(2025, 11, 21)
    assert dates.posted_since_cutoff("", NOW) is None


def test_locations(spark, texts):
    cases = {"Berlin, BE, Deutschland": ("Berlin", "Germany"), "Germany": ("", "Germany"), "Berlin": ("Berlin", ""),
             ", ,": ("", ""), None: ("", ""), '{"raw": "Wien, AT"}': ("Wien", "Austria"), "x, Narnia": ("x", "Narnia"),
             "Brno, Czechia": ("Brno", "Czech Republic"), "USA": ("", "United States")}
    df = places.with_location(texts(*cases), "t", "city", "country", places.alias_table(spark))
    got = {r["t"]: (r["city"], r["country"]) for r in df.collect()}
    assert got == cases


def test_country_tables(spark, column_of):
    assert len(places.CODE_TO_NAME) == 73
    aliases = {r["alias"]: r["canonical"] for r in places.alias_table(spark).collect()}
    assert aliases["frankreich"] == aliases["fr"] == aliases["francia"] == "France"
    assert aliases["cz"] == aliases["czechia"] == "Czech Republic"
    assert column_of(places.resolve_country_code, " DE ", "uk", "Narnia ", None) == ["Germany", "United Kingdom", "Narnia ", ""]


def test_list_fields(column_of):
    assert column_of(places.first_of, '["USA", "EU"]', "[]", "EU", None) == ["USA", "", "EU", ""]
    assert column_of(places.after_last_comma, "Berlin, X, Germany ", "Berlin", None) == ["Germany", "", ""]
    assert column_of(places.before_first_comma, " Berlin , Germany", "Berlin", None) == ["Berlin", "Berlin", ""]


def test_posting_key(spark):
    df = spark.createDataFrame([(["A", "B"], "u", "T", None), (["A"], None, None, "E")],
                               "found_on array<string>, platform_url string, title string, employer_name string")
    got = {r["k"] for r in df.select(keys.posting_key().alias("k")).collect()}
    assert got == {hashlib.sha1(x.encode()).hexdigest()[:32] for x in ("A B|u|T|", "A|None|None|E")}


def test_loose_json(column_of):
    def kept(c):
        return F.try_variant_get(verdicts.loose_json(c), "$.a", "int")

    good = ['{"a":1}', '{"a":1,}', "{'a':1}", "{a:1}", "/*x*/{'a':1,}", '{"a":1} // done']
    bad = ['{"a":', '{"a":1} trailing', "", None, "nonsense"]
    assert column_of(kept, *good, *bad) == [1] * len(good) + [None] * len(bad)


def test_ratings(column_of):
    cases = {"7.9": 7, "12": 10, "-1": 0, '"7"': 0, "null": 0, "true": 1, "false": 0, "NaN": 0, "1e99": 10, "[1]": 0}
    bodies = [f'{{"x": {v}}}' for v in cases]
    assert column_of(lambda c: verdicts.rating(verdicts.loose_json(c), "x"), *bodies, "{}") == [*cases.values(), 0]


def test_decisions(column_of):
    cases = {'"PASS"': "PASS", '"reject"': "reject", '"maybe"': "", "null": "", "1": ""}
    bodies = [f'{{"decision": {v}}}' for v in cases]
    assert column_of(lambda c: verdicts.decision(verdicts.loose_json(c)), *bodies) == list(cases.values())
    problems = column_of(lambda c: verdicts.decision_problem(verdicts.loose_json(c)), *bodies)
    assert [p is not None for p in problems] == [False, False, True, True, True]


def test_verdict_lists(column_of):
    got = column_of(lambda c: verdicts.string_list(verdicts.loose_json(c), "l"), '{"l": ["a", 1]}', '{"l": null}', '{"l": "x"}', "{}")
    assert got == [["a", "1"], [], [], []]
    got = column_of(lambda c: verdicts.theme_list(verdicts.loose_json(c), "l"), '{"l": ["a"]}', '{"l": "x"}', '{"l": null}', "{}")
    assert got == [["a"], ["x"], [], []]


def test_scores(spark):
    df = spark.createDataFrame([(8, 5), (8, 7), (10, 10)], "technical_match int, seniority_match int")
    exact = {"technical_match": 0.75, "seniority_match": 0.25}
    assert [r[0] for r in df.select(scores.recruiter_score(exact)).collect()] == [72, 78, 100]
    assert [r[0] for r in df.select(scores.recruiter_score({"technical_match": 0})).collect()] == [0, 0, 0]
    lists = spark.createDataFrame([(["a", "b"], ["c"], ["x", "y", "z"], ["d"]), (None, [], None, None)],
                                  "must_haves_met array<string>, must_haves_missing array<string>, "
                                  "themes_matched array<string>, disqualifiers_triggered array<string>")
    assert [r[0] for r in lists.select(scores.candidate_score()).collect()] == [30, 0]


def test_rescale_of_equal_values(spark):
    df = spark.createDataFrame([(5,), (5,)], "v int")
    assert {r[0] for r in df.select(scores.rescaled(F.col("v"), F.lit(5), F.lit(5))).collect()} == {0.0}


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_replies_that_end_in_white_space_and_hold_commas(column_of):
    def parsed(c):
        from pyspark.sql import functions as F
        return F.try_variant_get(verdicts.loose_json(c), "$.a", "string")
    replies = ['{"a": "x"}\n', '{"a": "x"}\r\n', '\t{"a": "x", }\t', '{"a": "p,]q", "b": [1, 2,],}\n', "{'a': 'it, }', }", '{"a": "q\\", ]",}', '{"a": "x"} cut']
    assert column_of(parsed, *replies) == ["x", "x", "x", "p,]q", "it, }", 'q", ]', None]


def test_written_dates(column_of):
    forms = ["Sun, 10 May 2026 14:00:00 +0000", "Sun, 10 May 2026 14:00:00 GMT", "05/10/2026 14:23 UTC", "2026/05/10T10:00:00Z", "20260510T142300Z",
             "May 10 2026", "May 10, 2026 14:23", "10 May 2026 14:23", "10 May, 2026", "10.05.2026", "10-05-2026", "2026.05.10",
             "2026-05-10T23:30:00-02:00"]
    got = column_of(lambda c: dates.parse_posted_at(c, NOW).cast("string"), *forms, "1747000000.0", "1.747E9")
    assert got == ["2026-05-10"] * 12 + ["2026-05-11"] + ["2025-05-11"] * 2
