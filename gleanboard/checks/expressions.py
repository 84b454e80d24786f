"""Checks of the column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, keys, places, scores, text, vectors, verdicts
from ..operators.passes import CANDIDATE, PRESCREEN, RECRUITER, read_replies
from ..schemas import RATINGS, VERDICT_LISTS
from ..session import settle
from ..sources.tables import nan_to_null
from .inputs import (DOCS, KEY_SQL, LABEL_QUERIES, LISTINGS, MATCHED, NOW, SCORE_SQL, VERDICTS, candidate_sql,
                     doc_postings, joined, joined_sql, label_queries, listings, recruiter_sql, replies,
                     squeezed, vector_index, ORDER)
from .registry import Inputs, check
from ..operators.dedupe import merge_across_sources

SPACES = r"[\s\p{Z}]+"
HTML_SQL = ("html", "regexp_replace(html, '<[^>]+>', ' ', 'g')")


def html_text_sql(column: str) -> str:
    bare = f"regexp_replace(coalesce({column}, ''), '<[^>]+>', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({bare}, '{SPACES}', ' ', 'g'))"


@check("h1_strip_html", f"SELECT page_id, {html_text_sql('html')} AS plain FROM pages")
def _(t: Inputs):
    return t.pages.select("page_id", text.strip_html(F.col("html")).alias("plain"))


@check("h2_strip_html_if_tagged", f"""
SELECT page_id, CASE WHEN contains(body, '<') THEN {html_text_sql('body')} ELSE body END AS plain
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'R&amp;D  at ' || url ELSE html END AS body FROM pages)""")
def _(t: Inputs):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("R&amp;D  at "), "url")).otherwise(F.col("html"))
    return t.pages.select("page_id", body.alias("body")).select(
        "page_id", text.strip_html_if_tagged(F.col("body")).alias("plain"))


@check("h3_match_text", f"""
WITH {LISTINGS} SELECT l_orderkey, l_linenumber, {squeezed('title')} AS title_key,
  {squeezed('employer_name')} AS employer_key FROM l""")
def _(t: Inputs):
    return listings(t).select("l_orderkey", "l_linenumber", text.match_text(F.col("title")).alias("title_key"),
                              text.match_text(F.col("employer_name")).alias("employer_key"))


# Spellings a source may use for a country, by nation.
SPELLINGS = ["Deutschland", " DE ", "frankreich", "uk", "U.S.A.", "Pays-Bas", "Spanje"]
CANONICAL = ["Germany", "Germany", "France", "United Kingdom", "United States", "Netherlands", "Spain"]


def _spelled(i):
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SPELLINGS]), F.pmod(i, F.lit(9)).cast("int")),
                      F.concat(F.lit(" NATION_"), i.cast("string"), F.lit(" ")))


def _spelled_sql(i: str, names: list[str], other: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(names))
    return f"CASE {i} % 9 {cases} ELSE {other} END"


@check("h4_canonical_country", f"""
SELECT c_custkey, {_spelled_sql('c_custkey', CANONICAL, "'NATION_' || c_custkey")} AS country FROM customer""")
def _(t: Inputs):
    df = t.customer.select("c_custkey", _spelled(F.col("c_custkey")).alias("name"))
    return places.with_country(df, "name", "country", places.alias_table(t.spark)).select("c_custkey", "country")


@check("c8_alias_join", f"""
SELECT country, count(*) AS customers FROM
  (SELECT {_spelled_sql('c_custkey', CANONICAL, "'NATION'")} AS country FROM customer) GROUP BY country""")
def _(t: Inputs):
    df = t.customer.select(F.when(F.col("c_custkey") % 9 > 6, F.lit("NATION")).otherwise(
        _spelled(F.col("c_custkey"))).alias("name"))
    return places.with_country(df, "name", "country", places.alias_table(t.spark)).groupBy("country").agg(
        F.count(F.lit(1)).alias("customers"))


@check("h5_alias_coverage", f"""
SELECT alias, country, customers FROM (
  SELECT lower(trim({_spelled_sql('c_custkey', SPELLINGS, "NULL")})) AS alias,
    {_spelled_sql('c_custkey', CANONICAL, "NULL")} AS country, count(*) AS customers FROM customer GROUP BY 1, 2)
WHERE alias IS NOT NULL""")
def _(t: Inputs):
    spelled = t.customer.select(F.lower(text.strip(_spelled(F.col("c_custkey")))).alias("alias"))
    return (spelled.join(places.alias_table(t.spark), "alias").groupBy("alias", F.col("canonical").alias("country"))
            .agg(F.count(F.lit(1)).alias("customers")))


@check("h6_split_location", f"""
WITH c AS (SELECT c_custkey, {_spelled_sql('c_custkey', CANONICAL, "'NATION_' || c_custkey")} AS name FROM customer)
SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN c_custkey || 'ville' WHEN 1 THEN CASE WHEN c_custkey % 9 > 6 THEN name ELSE '' END
    WHEN 2 THEN 'Town' ELSE '' END AS city,
  CASE c_custkey % 4 WHEN 0 THEN name WHEN 1 THEN CASE WHEN c_custkey % 9 > 6 THEN '' ELSE name END
    WHEN 2 THEN name ELSE '' END AS country FROM c""")
def _(t: Inputs):
    i, name = F.col("c_custkey"), _spelled(F.col("c_custkey"))
    location = (F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("ville, Region , "), name))
                .when(i % 4 == 1, name)
                .when(i % 4 == 2, F.concat(F.lit('{"raw": "Town,,'), name, F.lit('"}')))
                .otherwise(F.when(i % 8 == 3, " , ,")))
    df = t.customer.select("c_custkey", location.alias("location"))
    return places.with_location(df, "location", "city", "country", places.alias_table(t.spark)).select(
        "c_custkey", "city", "country")


# Posted-at texts in every supported form, by event.
_POSTED = """CASE event_id % 9 WHEN 0 THEN epoch WHEN 1 THEN epoch || '000' WHEN 2 THEN iso
  WHEN 3 THEN 'Posted ' || (event_id % 50) || ' days ago' WHEN 4 THEN '' WHEN 5 THEN iso || 'T10:00:00Z'
  WHEN 6 THEN 'Just now' WHEN 7 THEN (event_id % 30) || '+ weeks ago' ELSE 'yesterday' END"""
_DATES_SQL = """
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day,
  CASE event_id % 9 WHEN 3 THEN DATE '2026-05-20' - CAST(event_id % 50 AS INTEGER)
    WHEN 4 THEN NULL WHEN 6 THEN DATE '2026-05-20' WHEN 7 THEN NULL WHEN 8 THEN DATE '2026-05-19'
    ELSE CAST(ts AS DATE) END AS posted FROM events)
"""


def _posted(t: Inputs):
    i = F.col("event_id")
    epoch = (F.unix_date(F.to_date("ts")).cast("bigint") * 86_400).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd")
    return t.events.select("event_id", F.when(i % 9 == 0, epoch).when(i % 9 == 1, F.concat(epoch, F.lit("000")))
                           .when(i % 9 == 2, iso)
                           .when(i % 9 == 3, F.concat(F.lit("Posted "), (i % 50).cast("string"), F.lit(" days ago")))
                           .when(i % 9 == 4, "").when(i % 9 == 5, F.concat(iso, F.lit("T10:00:00Z")))
                           .when(i % 9 == 6, "Just now")
                           .when(i % 9 == 7, F.concat((i % 30).cast("string"), F.lit("+ weeks ago")))
                           .otherwise("yesterday").alias("posted_text"))


WRITTEN = ["EEE, d MMM yyyy HH:mm:ss' +0000'", "EEE, d MMM yyyy HH:mm:ss' GMT'", "MM/dd/yyyy HH:mm' UTC'", "yyyy/MM/dd'T'HH:mm:ss'Z'",
           "yyyyMMdd'T'HHmmss'Z'", "MMM d yyyy", "MMM d, yyyy HH:mm", "d MMM yyyy HH:mm", "d MMM, yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "yyyy.MM.dd",
           "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss"]


@check("h7_written_dates", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t: Inputs):
    """Every event's date in one of the written forms."""
    written = F.lit(None).cast("string")
    for i, form in enumerate(WRITTEN):
        written = F.when(F.col("event_id") % len(WRITTEN) == i, F.date_format("ts", form)).otherwise(written)
    return t.events.select("event_id", dates.parse_posted_at(written, NOW).alias("day"))


@check("h7_parse_posted_at", _DATES_SQL + """
SELECT event_id, coalesce(strftime(posted, '%Y-%m-%d'), '') AS posted FROM e""")
def _(t: Inputs):
    day = dates.parse_posted_at(F.col("posted_text"), NOW)
    return _posted(t).select("event_id", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")).alias("posted"))


@check("h8_render_date", _DATES_SQL + """
SELECT event_id, coalesce(strftime(posted, '%y/%m/%d'), '') AS posted FROM e""")
def _(t: Inputs):
    day = dates.parse_posted_at(F.col("posted_text"), NOW)
    return _posted(t).select("event_id", F.coalesce(dates.render_date(day), F.lit("")).alias("posted"))


@check("h9_country_code", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Czech Republic' WHEN 2 THEN 'United Kingdom'
  WHEN 3 THEN ' Narnia' ELSE '' END AS country FROM customer""")
def _(t: Inputs):
    i = F.col("c_custkey")
    code = F.when(i % 5 == 0, " DE ").when(i % 5 == 1, "cz").when(i % 5 == 2, "uk").when(i % 5 == 3, " Narnia")
    return t.customer.select("c_custkey", places.resolve_country_code(code).alias("country"))


@check("h10_first_or_empty", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' WHEN 2 THEN '' ELSE p_name END AS first
FROM part""")
def _(t: Inputs):
    i = F.col("p_partkey")
    value = (F.when(i % 4 == 0, F.to_json(F.array("p_brand", "p_name"))).when(i % 4 == 1, "[]")
             .when(i % 4 == 3, F.col("p_name")))
    return t.part.select("p_partkey", places.first_of(value).alias("first"))


@check("h11_comma_parts", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS after_last,
  CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE s_name END AS before_first
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t: Inputs):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    hq = F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(
        F.concat("s_name", F.lit(" , x, "), "n_name", F.lit(" ")))
    return df.select("s_suppkey", places.after_last_comma(hq).alias("after_last"),
                     places.before_first_comma(hq).alias("before_first"))


@check("h12_joined_or_null", """
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_type || ', ' || p_brand END, 'none') AS types FROM part""")
def _(t: Inputs):
    types = F.when(F.col("p_partkey") % 3 > 0, F.array("p_type", "p_brand")).otherwise(
        F.array().cast("array<string>"))
    return t.part.select("p_partkey", F.coalesce(places.joined_or_null(types), F.lit("none")).alias("types"))


@check("h13_joined_fields", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE n_name || ';' || s_name END AS names,
  CAST(n_nationkey AS VARCHAR) AS codes
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t: Inputs):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    first = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("n_name"))
    places_list = F.array(
        F.struct(F.col("n_nationkey").cast("string").alias("alpha2"), first.alias("name")),
        F.struct(F.lit(None).cast("string").alias("alpha2"), F.col("s_name").alias("name")))
    return df.select("s_suppkey", places.joined_field(places_list, "name").alias("names"),
                     places.joined_field(places_list, "alpha2").alias("codes"))


@check("h14_posting_key", f"""
WITH {MATCHED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {KEY_SQL} AS key FROM merged""")
def _(t: Inputs):
    return merge_across_sources(listings(t), ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", keys.posting_key().alias("key"))


@check("h15_retrieval_text", f"""
WITH {DOCS} SELECT key, title || chr(10) || employer_name || chr(10) || city || chr(10) || description AS document
FROM p""")
def _(t: Inputs):
    return doc_postings(t).select("key", text.retrieval_text(
        *[F.col(c) for c in ("title", "employer_name", "city", "description")]).alias("document"))


@check("h16_metadata", f"""
WITH {DOCS} SELECT key, 'city=' || city || CASE WHEN country IS NULL THEN '' ELSE ';country=' || country END
  || ';employer_name=' || employer_name || ';key=' || key AS meta FROM p""")
def _(t: Inputs):
    df = doc_postings(t)
    entries = F.array_sort(F.map_entries(keys.metadata(df.columns)))
    return df.select("key", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                         ";").alias("meta"))


_NOISY_NAME = "'  ' || p_name || '!!' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN '--' ELSE ' x.y_z ' END"


def _noisy_name():
    return F.concat(F.lit("  "), "p_name", F.lit("!!"), "p_brand",
                    F.when(F.col("p_partkey") % 5 == 0, "--").otherwise(" x.y_z "))


@check("h17_slug", f"""
SELECT p_partkey, coalesce(nullif(lower(trim(regexp_replace(CASE WHEN p_partkey % 7 = 0 THEN '?!' ELSE {_NOISY_NAME} END,
  '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'x') AS slug FROM part""")
def _(t: Inputs):
    name = F.when(F.col("p_partkey") % 7 == 0, "?!").otherwise(_noisy_name())
    return t.part.select("p_partkey", text.slug(name).alias("slug"))


@check("h18_file_safe", f"""
SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(coalesce(CASE WHEN p_partkey % 7 <> 0
  THEN {_NOISY_NAME} || {_NOISY_NAME} || {_NOISY_NAME} END, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 60), ''),
  'untitled') AS name FROM part""")
def _(t: Inputs):
    name = F.when(F.col("p_partkey") % 7 != 0, F.concat(_noisy_name(), _noisy_name(), _noisy_name()))
    return t.part.select("p_partkey", text.file_safe(name).alias("name"))


@check("h19_query_label", rf"""
SELECT p_partkey, coalesce(nullif(regexp_replace(lower(trim(coalesce(CASE WHEN p_partkey % 7 <> 0
  THEN {_NOISY_NAME} END, ''))), '{SPACES}', '_', 'g'), ''), 'query') AS label FROM part""")
def _(t: Inputs):
    return t.part.select("p_partkey", text.query_label(F.when(F.col("p_partkey") % 7 != 0, _noisy_name())).alias("label"))


_POSTING_SQL = """'Title: ' || title || chr(10) || 'Company: ' || employer_name || chr(10) || 'Location: ' || city || ', '
  || coalesce(country, 'None') || chr(10)"""


@check("h20_posting_text", f"""
WITH {DOCS} SELECT key, {_POSTING_SQL} || 'Description: ' || description AS body FROM p""")
def _(t: Inputs):
    return doc_postings(t).select("key", text.posting_text().alias("body"))


@check("h21_answer_text", f"""
WITH {DOCS} SELECT key, {_POSTING_SQL} || 'Posted: ' || strftime(posted_at, '%y/%m/%d') || chr(10) ||
  'Description: ' || description AS body FROM p""")
def _(t: Inputs):
    return doc_postings(t).select("key", text.answer_text().alias("body"))


@check("h22_pass_message", f"""
WITH {DOCS} SELECT key, 'Your knowledge cutoff date is outdated, the current month is actually May 2026.' || chr(10)
  || chr(10) || 'CANDIDATE CV:' || chr(10) || 'CV of ' || source || chr(10) || chr(10) || 'JOB POSTING:' || chr(10) ||
  {_POSTING_SQL} || 'Description: ' || description AS message FROM p""")
def _(t: Inputs):
    cv = F.concat(F.lit("CV of "), F.col("source"))
    return doc_postings(t).select("key", text.cv_message(cv, text.posting_text(), NOW).alias("message"))


@check("h23_loose_json", """
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 5 = 3 THEN 'could not parse model JSON output' ELSE '' END AS error FROM events""")
def _(t: Inputs):
    i = F.col("event_id")
    damaged = (F.when(i % 5 == 1, F.regexp_replace("props", r"\}", ", }"))
               .when(i % 5 == 2, F.replace(F.col("props"), F.lit('"'), F.lit("'")))
               .when(i % 5 == 3, F.regexp_replace("props", r"[0-9]+\}", ""))
               .when(i % 5 == 4, F.concat(F.lit("/* reply */ "), F.replace(F.col("props"), F.lit('"'), F.lit(""))))
               .otherwise(F.col("props")))
    parsed = t.events.select("event_id", damaged.alias("reply")).withColumn("v", verdicts.loose_json(F.col("reply")))
    return parsed.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.lit(-1)).alias("k"),
                         F.coalesce(verdicts.json_error(F.col("reply"), F.col("v")), F.lit("")).alias("error"))


@check("h23_real_replies", """
SELECT doc_id, coalesce(text, '') AS notes, doc_id % 11 AS score FROM documents""")
def _(t: Inputs):
    """Replies as models write them: indented, ended by line breaks, with commas and brackets inside the text."""
    notes = F.coalesce("text", F.lit(""))
    body = F.to_json(F.struct(F.concat(notes, F.lit(",]")).alias("notes"), (F.col("doc_id") % 11).alias("score")))
    i = F.col("doc_id")
    reply = (F.when(i % 4 == 0, F.concat(body, F.lit("\n")))
             .when(i % 4 == 1, F.concat(F.lit("  \n"), F.regexp_replace(body, r"\}$", ",\n}\r\n")))
             .when(i % 4 == 2, F.concat(F.lit("\t"), body, F.lit("\t \n\n"))).otherwise(body))
    v = verdicts.loose_json(F.col("reply"))
    parsed = t.documents.select("doc_id", reply.alias("reply")).withColumn("v", v)
    return parsed.select("doc_id", F.regexp_replace(F.try_variant_get("v", "$.notes", "string"), r",\]$", "").alias("notes"),
                         F.try_variant_get("v", "$.score", "bigint").alias("score"))


@check("h24_render_list", f"""
WITH {MATCHED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(found_on, ', ') AS found_on FROM merged""")
def _(t: Inputs):
    return merge_across_sources(listings(t), ORDER).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", keys.render_list(F.col("found_on")).alias("found_on"))


def verdicts_of(t: Inputs, spec, column: str):
    rows = replies(t).select("key", F.col(column).alias("reply"), "call_error")
    return read_replies(rows, spec, ["key"])


def stored_verdicts(t: Inputs, spec, column: str):
    """Verdicts as a run leaves them: stored, so that a filter on a score reads
    a column and does not parse the reply again."""
    return settle(verdicts_of(t, spec, column))


@check("h25_decision", f"WITH {VERDICTS} SELECT key, decision, undecided AS failed FROM r")
def _(t: Inputs):
    return verdicts_of(t, PRESCREEN, "prescreen").select("key", "decision", F.col("error").isNotNull().alias("failed"))


@check("h26_ratings", f"WITH {VERDICTS} SELECT key, {', '.join(RATINGS)}, failed FROM r")
def _(t: Inputs):
    return verdicts_of(t, RECRUITER, "recruiter").select("key", *RATINGS, F.col("error").isNotNull().alias("failed"))


@check("h27_verdict_lists", f"WITH {VERDICTS} SELECT key, {', '.join(joined_sql(c) for c in VERDICT_LISTS)} FROM r")
def _(t: Inputs):
    return verdicts_of(t, CANDIDATE, "candidate").select("key", *[joined(c) for c in VERDICT_LISTS])


@check("h28_unit_cosine", f"""
WITH {LABEL_QUERIES} SELECT vec_id, {SCORE_SQL} AS score,
  round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM embeddings JOIN q USING (label)""")
def _(t: Inputs):
    q = label_queries(t).select("label", F.col("embedding").alias("q_emb"))
    return vector_index(t).join(q, "label").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q_emb")), 6).alias("score"),
        F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@check("h28_normalise", """
SELECT vec_id, round(list_sum(list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 4)),
  lambda x: x / nullif(1 + vec_id % 4, 0))), 4) AS total FROM embeddings""")
def _(t: Inputs):
    scale = (F.lit(1) + F.col("vec_id") % 4).cast("double")
    longer = F.transform("embedding", lambda x: x.cast("double") * scale)
    return t.embeddings.select("vec_id", F.round(F.aggregate(
        vectors.unit(longer), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# Weights of the settings file and of the screen.
SCREEN_WEIGHTS = {"technical_match": 0.4, "seniority_match": 0.6, "transferability": 0.0, "trajectory": 0.0,
                  "soft_skills": 0.0}
EXACT_WEIGHTS = {"technical_match": 0.75, "seniority_match": 0.25}


@check("h29_recruiter_score", f"""
WITH {VERDICTS} SELECT key, {recruiter_sql(scores.RECRUITER_WEIGHTS)} AS by_default,
  {recruiter_sql(SCREEN_WEIGHTS)} AS by_screen, {recruiter_sql(EXACT_WEIGHTS)} AS by_exact, 0 AS by_nothing FROM r""")
def _(t: Inputs):
    return verdicts_of(t, RECRUITER, "recruiter").select(
        "key", scores.recruiter_score().alias("by_default"), scores.recruiter_score(SCREEN_WEIGHTS).alias("by_screen"),
        scores.recruiter_score(EXACT_WEIGHTS).alias("by_exact"),
        scores.recruiter_score({"technical_match": 0.0}).alias("by_nothing"))


@check("h30_candidate_score", f"WITH {VERDICTS} SELECT key, {candidate_sql(scores.CANDIDATE_WEIGHTS)} AS candidate_score FROM r")
def _(t: Inputs):
    return verdicts_of(t, CANDIDATE, "candidate").select("key", scores.candidate_score().alias("candidate_score"))


@check("h32_form_coercion", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS text_value,
  CAST(CASE event_id % 3 WHEN 2 THEN event_id ELSE 20 END AS INTEGER) AS int_value FROM events""")
def _(t: Inputs):
    i = F.col("event_id")
    field = F.when(i % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit("\t"))).when(
        i % 3 == 2, F.concat(i.cast("string"), F.lit(" ")))
    return t.events.select("event_id", text.form_text(field).alias("text_value"), text.form_int(field, 20).alias("int_value"))


@check("h33_nan_to_null", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'null' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS cents FROM events""")
def _(t: Inputs):
    df = t.events.select("event_id", F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(
        F.col("value")).alias("value"))
    return nan_to_null(df).select("event_id", F.coalesce(F.round(F.col("value") * 100).cast("bigint").cast("string"),
                                                         F.lit("null")).alias("cents"))


@check("h35_failed_verdicts", f"""
WITH {VERDICTS} SELECT key, technical_match, len(themes_matched) AS n_themes, decision FROM r WHERE failed""")
def _(t: Inputs):
    r = stored_verdicts(t, RECRUITER, "recruiter").where(F.col("error").isNotNull()).select("key", "technical_match")
    c = stored_verdicts(t, CANDIDATE, "candidate").where(F.col("error").isNotNull()).select(
        "key", F.size("themes_matched").cast("bigint").alias("n_themes"))
    p = verdicts_of(t, PRESCREEN, "prescreen").select("key", "decision")
    return r.join(c, "key").join(p, "key")
