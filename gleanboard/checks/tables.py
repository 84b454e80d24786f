"""Checks of sources, sinks, filters, joins, aggregates, ranks and sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from ..functions.keys import render_list
from ..functions.scores import CANDIDATE_WEIGHTS, RECRUITER_WEIGHTS, candidate_score, recruiter_score
from ..functions.text import first_filled
from ..functions.vectors import cosine
from ..operators import filters, joins, nearest, ranking, summary
from ..operators.dedupe import (duplicate_report, duplicated_keys, first_spellings, has_match_parts, keep_first,
                                merge_across_sources, with_keys)
from ..operators.passes import CANDIDATE, PRESCREEN, RECRUITER, from_records, to_records
from ..plans.ask import contexts
from ..plans.collect import ingest, union_sources
from ..plans.index import to_embed
from ..schemas import POSTING, VERDICT_LISTS, conform
from ..session import scratch_path, settle
from ..sources import tables
from .expressions import SCREEN_WEIGHTS, stored_verdicts, verdicts_of
from .inputs import (DOCS, IDS, IDS_SQL, KEY_SQL, LABEL_QUERIES, LISTINGS, MATCHED, NOW, ORDER, ORDER_SQL,
                     CUT_SQL, SCORE_SQL, VERDICTS, candidate_sql, doc_postings, joined, joined_sql, label_queries, listings,
                     recruiter_sql, replies, vector_index)
from .registry import Inputs, check

DAY_SQL = "coalesce(strftime(posted_at, '%Y-%m-%d'), '')"


def day(column: str = "posted_at"):
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit("")).alias("posted")


def merged(t: Inputs):
    return merge_across_sources(listings(t), ORDER)


def keyed(t: Inputs):
    return with_keys(merged(t))


# -- stored tables -------------------------------------------------------------

@check("a10_read_postings", f"""
WITH {DOCS} SELECT key, title, coalesce(country, '') AS country, 'none' AS found_on, '' AS match_key FROM p""")
def _(t: Inputs):
    path = scratch_path(t.spark, "postings")
    doc_postings(t).drop("n_chars").write.parquet(path)
    return tables.read_postings(t.spark, path).select(
        "key", "title", F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce(F.array_join("found_on", ","), F.lit("none")).alias("found_on"),
        F.coalesce("match_key", F.lit("")).alias("match_key"))


@check("a11_parquet_sink", f"""
WITH {MATCHED} SELECT {IDS_SQL}, title, city, array_to_string(found_on, ',') AS found_on, 0 AS has_raw FROM merged""")
def _(t: Inputs):
    path = scratch_path(t.spark, "parquet")
    tables.write_parquet(merged(t).withColumn("raw", F.to_json(F.struct("title", "city"))), path)
    stored = t.spark.read.parquet(path)
    return stored.select(*IDS, "title", "city", joined("found_on"), F.lit(int("raw" in stored.columns)).alias("has_raw"))


def read_csv(t: Inputs, path: str):
    """Every character of a stored CSV, white space included."""
    return t.spark.read.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


@check("a12_csv_sink", f"""
WITH {MATCHED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, title,
  array_to_string(found_on, ', ') AS found_on, 0 AS has_description FROM merged""")
def _(t: Inputs):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(merged(t), path)
    stored = read_csv(t, path)
    return stored.select(*[F.col(c).cast("bigint").alias(c) for c in IDS], "title", "found_on",
                         F.lit(int("description" in stored.columns)).alias("has_description"))


@check("a13_raw_sink", f"""
WITH {DOCS} SELECT employer_name AS platform, replace(lang || '_' || title, ' ', '_') AS name,
  title AS raw_title FROM p""")
def _(t: Inputs):
    path = scratch_path(t.spark, "raw")
    df = doc_postings(t).select(F.col("employer_name").alias("source_platform"), F.col("lang").alias("employer_name"),
                                "title", F.to_json(F.struct("title", "description")).alias("raw"))
    tables.write_raw(df, path)
    return t.spark.read.schema("name string, raw string, platform string").json(path).select(
        "platform", "name", F.get_json_object("raw", "$.title").alias("raw_title"))


def match_table(t: Inputs):
    """Scored postings as a match leaves them."""
    r = stored_verdicts(t, RECRUITER, "recruiter").withColumn("recruiter_score", recruiter_score()).drop("error")
    c = stored_verdicts(t, CANDIDATE, "candidate").withColumn("candidate_score", candidate_score())
    return joins.with_verdicts(doc_postings(t).select("key", "title", "employer_name", "city", "country", "description"),
                               c, r)


SCORED = VERDICTS + f""",
s AS (SELECT r.*, {recruiter_sql(RECRUITER_WEIGHTS)} AS recruiter_score,
  {candidate_sql(CANDIDATE_WEIGHTS)} AS candidate_score FROM r)
"""


@check("a14_match_artefacts", f"""
WITH {SCORED} SELECT key, 'Posting ' || doc_id AS title, CAST(recruiter_score AS VARCHAR) AS recruiter_score,
  CAST(candidate_score AS VARCHAR) AS candidate_score,
  CASE WHEN failed THEN 'candidate failed at key ''' || key || ''': timeout' ELSE '' END AS error FROM s""")
def _(t: Inputs):
    path = scratch_path(t.spark, "match")
    tables.write_match(match_table(t), label_queries(t), path)
    return t.spark.read.option("header", True).csv(f"{path}/summary.csv").select(
        "key", "title", "recruiter_score", "candidate_score", F.coalesce("error", F.lit("")).alias("error"))


def _records(t: Inputs, run: str):
    v = verdicts_of(t, PRESCREEN, "prescreen").withColumn("profile_id", F.lit("p"))
    return to_records(v, PRESCREEN, run)


@check("a15_verdict_sink", f"""
WITH {VERDICTS} SELECT 'run-1' AS run_id, 'prescreen' AS pass, key, decision, undecided AS failed,
  'Posting ' || doc_id AS title FROM r""")
def _(t: Inputs):
    path = scratch_path(t.spark, "verdicts")
    tables.write_verdicts(_records(t, "run-1"), path)
    tables.write_verdicts(_records(t, "run-1"), path)  # a repeated pass replaces itself
    stored = tables.verdict_preview(tables.read_verdicts(t.spark, path), doc_postings(t))
    return stored.select("run_id", "pass", "key", F.get_json_object("payload", "$.decision").alias("decision"),
                         F.col("error").isNotNull().alias("failed"), "title")


@check("a16_verdict_source", f"WITH {VERDICTS} SELECT key, decision FROM r WHERE NOT undecided")
def _(t: Inputs):
    path = scratch_path(t.spark, "verdicts")
    tables.write_verdicts(_records(t, "run-1").unionByName(_records(t, "run-2")), path)
    usable = tables.read_verdicts(t.spark, path, "run-2", usable=True)
    return from_records(usable, PRESCREEN).select("key", "decision")


@check("a17_embedding_table", """
SELECT 'd' || vec_id AS key, 'm' AS model, len(embedding) AS dimensions FROM embeddings""")
def _(t: Inputs):
    path = scratch_path(t.spark, "embeddings")
    rows = vector_index(t).withColumn("model", F.lit("m"))
    tables.append_embeddings(rows.where("vec_id % 2 = 0"), path)
    tables.append_embeddings(rows.where("vec_id % 2 = 1"), path)
    tables.append_embeddings(rows.withColumn("model", F.lit("other")), path)
    return tables.read_embeddings(t.spark, path, "m").select("key", "model", F.size("embedding").cast("bigint").alias("dimensions"))


@check("a18_profiles", """
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 5 = 1 THEN 'one' ELSE 'a|b' END AS role_themes,
  CASE WHEN conv_id % 5 IN (0, 4) THEN '' ELSE role END AS search_query,
  CASE WHEN conv_id % 5 = 4 THEN '' WHEN conv_id % 5 = 0 THEN '' ELSE '' END AS disqualifiers,
  CASE WHEN conv_id % 5 = 4 THEN 'a profile is a JSON object' ELSE '' END AS problem
FROM conversations WHERE TRUE""".replace("WHEN conv_id % 5 = 1 THEN 'one'", "WHEN conv_id % 5 = 4 THEN '' WHEN conv_id % 5 = 1 THEN 'one'"))
def _(t: Inputs):
    i = F.col("conv_id")
    body = (F.when(i % 5 == 0, " ").when(i % 5 == 1, F.concat(F.lit('{"role_themes": "one", "search_query": "'), "role", F.lit('"}')))
            .when(i % 5 == 4, "[1, 2]")
            .otherwise(F.concat(F.lit('{"role_themes": ["a", "b"], "disqualifiers": null, "search_query": "'), "role", F.lit('"}'))))
    rows = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("profile_id"), "conv_id", "turn", body.alias("value"))
    parsed = rows.select("conv_id", "turn", *tables.profile_columns())
    return parsed.select("conv_id", "turn", F.array_join("role_themes", "|").alias("role_themes"), "search_query",
                         F.array_join("disqualifiers", "|").alias("disqualifiers"),
                         F.coalesce("problem", F.lit("")).alias("problem"))


@check("a19_append_postings", f"""
WITH {LISTINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY employer_name, title, city
  ORDER BY CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END, {ORDER_SQL}) AS rn FROM l)
SELECT {IDS_SQL}, l_returnflag, title FROM ranked WHERE rn = 1""")
def _(t: Inputs):
    both = listings(t)
    out = tables.append_postings(both.where("l_returnflag <> 'N'"), both.where("l_returnflag = 'N'"), ORDER)
    return out.select(*IDS, "l_returnflag", "title")


@check("a20_export_scored", f"""
WITH {VERDICTS} SELECT key, {recruiter_sql(SCREEN_WEIGHTS)} AS recruiter_score, {joined_sql('themes_matched')},
  CAST({recruiter_sql(SCREEN_WEIGHTS)} AS VARCHAR) AS csv_score, array_to_string(themes_matched, ', ') AS csv_themes, 0 AS csv_description FROM r""")
def _(t: Inputs):
    from ..plans.match import rescore

    path = scratch_path(t.spark, "export")
    tables.export_scored(rescore(match_table(t), SCREEN_WEIGHTS, CANDIDATE_WEIGHTS), path)
    whole, flat = t.spark.read.parquet(f"{path}/matches.parquet"), read_csv(t, f"{path}/matches.csv")
    light = flat.select("key", F.col("recruiter_score").alias("csv_score"), F.coalesce("themes_matched", F.lit("")).alias("csv_themes"),
                        F.lit(int("description" in flat.columns)).alias("csv_description"))
    return whole.select("key", "recruiter_score", joined("themes_matched")).join(light, "key")


@check("a21_run_registry", "SELECT 'run-' || label AS run_id, label FROM (SELECT DISTINCT label FROM embeddings)")
def _(t: Inputs):
    path = scratch_path(t.spark, "runs")
    rows = t.embeddings.select("label").distinct()
    tables.register_run(t.spark, path, "first", NOW, {"top_n": 200}, rows.withColumn("x", F.lit(1)))
    stored = t.spark.read.parquet(f"{path}/profiles")
    return stored.join(F.broadcast(t.spark.read.parquet(f"{path}/runs").select("run_id")), "run_id").select(
        F.concat(F.lit("run-"), "label").alias("run_id"), "label")


# -- projections and filters -----------------------------------------------------

@check("b1_conform", f"""
WITH {LISTINGS} SELECT l_orderkey, l_linenumber, title, '' AS job_url, -1 AS employer_rating, {DAY_SQL} AS posted FROM l""")
def _(t: Inputs):
    out = conform(listings(t), POSTING, keep=("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", "l_linenumber", "title", F.coalesce("job_url", F.lit("")).alias("job_url"),
                      F.coalesce("employer_rating", F.lit(-1)).cast("int").alias("employer_rating"), day())


@check("b2_constant_tags", """
SELECT l_returnflag, 'board' AS actor, 'data_query' AS search_label, count(*) AS rows FROM lineitem GROUP BY 1""")
def _(t: Inputs):
    rows = union_sources({"board": t.lineitem.select("l_returnflag").withColumn("title", F.lit("a DATA query"))})
    tagged = filters.keyword_hits(rows, [" Data  Query", "data query"], ["title"])
    return tagged.groupBy("l_returnflag", "actor", "search_label").agg(F.count(F.lit(1)).alias("rows"))


@check("b3_first_filled", f"""
WITH {LISTINGS} SELECT l_orderkey, l_linenumber,
  CASE WHEN city <> '' THEN city WHEN platform_url <> '' THEN platform_url ELSE 'none' END AS place FROM l""")
def _(t: Inputs):
    return listings(t).select("l_orderkey", "l_linenumber",
                              first_filled(F.col("city"), F.col("platform_url"), F.lit("none")).alias("place"))


@check("b4_effective_source", f"""
WITH {LISTINGS} SELECT coalesce(nullif(source_platform, ''), actor) AS source, count(*) AS rows FROM l GROUP BY 1""")
def _(t: Inputs):
    return listings(t).groupBy(filters.effective_source().alias("source")).agg(F.count(F.lit(1)).alias("rows"))


@check("b5_preview", f"""
WITH {MATCHED} SELECT title, employer_name, city, array_to_string(found_on, ', ') AS found_on,
  l_quantity AS rec_sc FROM merged""")
def _(t: Inputs):
    return tables.preview(merged(t), ["title", "employer_name", "city", "missing", "l_quantity", "found_on"],
                          {"l_quantity": "rec_sc"})


LISTING_NOW = dt.datetime(2001, 3, 1, 12)


@check("b6_recent", f"""
WITH {LISTINGS} SELECT l_orderkey, l_linenumber, {DAY_SQL} AS posted FROM l
WHERE posted_at IS NULL OR posted_at >= DATE '2001-03-01' - 90""")
def _(t: Inputs):
    return filters.recent(listings(t), "3 months ago", LISTING_NOW).select("l_orderkey", "l_linenumber", day())


@check("b7_remote", """
SELECT event_id FROM events WHERE event_type = 'click' OR user_id % 3 = 1""")
def _(t: Inputs):
    flag = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "view", False)
    tags = F.when(F.col("user_id") % 3 == 1, F.array(F.lit("Full-Time"), F.lit("100-REMOTE"))).when(
        F.col("user_id") % 3 == 2, F.array("event_type"))
    return t.events.where(filters.is_remote(flag, tags)).select("event_id")


@check("b8_location_matches", f"""
WITH {LISTINGS}, m AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 'Worldwide' ELSE city END AS place FROM l)
SELECT l_orderkey, l_linenumber, place FROM m
WHERE place <> '' AND (contains(lower(place), 'worldwide') OR contains(lower(place), 'nation_1'))""")
def _(t: Inputs):
    df = listings(t).withColumn("place", F.when(F.col("l_linenumber") == 1, "Worldwide").otherwise(F.col("city")))
    return df.where(filters.location_matches(F.col("place"), "NATION_1")).select("l_orderkey", "l_linenumber", "place")


@check("b9_sentinel", """
SELECT event_id, coalesce(type, 'none') AS type FROM (SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'job_wwr_blocked' WHEN event_type <> 'view' THEN event_type END AS type FROM events)
WHERE type IS DISTINCT FROM 'job_wwr_blocked'""")
def _(t: Inputs):
    df = t.events.select("event_id", F.when(F.col("event_type") == "error", filters.BLOCKED_TYPE).when(
        F.col("event_type") != "view", F.col("event_type")).alias("type"))
    return filters.without_sentinel(df).select("event_id", F.coalesce("type", F.lit("none")).alias("type"))


@check("b10_metadata_filter", f"WITH {DOCS} SELECT key FROM p WHERE city = 'en' AND country = 'EN'")
def _(t: Inputs):
    return filters.metadata_filter(doc_postings(t), city="en", country="EN", employer_name="").select("key")


@check("b11_fail_open", f"WITH {VERDICTS} SELECT key, decision FROM r WHERE lower(decision) <> 'reject'")
def _(t: Inputs):
    v = stored_verdicts(t, PRESCREEN, "prescreen")
    return v.where(filters.not_rejected(F.col("decision"))).select("key", "decision")


@check("b12_threshold", f"WITH {SCORED} SELECT key, recruiter_score FROM s WHERE recruiter_score >= 65")
def _(t: Inputs):
    v = stored_verdicts(t, RECRUITER, "recruiter").withColumn("recruiter_score", recruiter_score())
    return filters.at_least(v, "recruiter_score", 65).select("key", "recruiter_score")


@check("b13_match_parts", f"""
WITH {MATCHED} SELECT (e_ <> '' AND t_ <> '' AND c_ <> '') AS keyed, count(*) AS rows FROM n GROUP BY 1""")
def _(t: Inputs):
    return listings(t).groupBy(has_match_parts().alias("keyed")).agg(F.count(F.lit(1)).alias("rows"))


def with_gaps(t: Inputs):
    """The index with missing vectors."""
    return vector_index(t).withColumn("embedding", F.when(F.col("vec_id") % 13 != 0, F.col("embedding")))


@check("b14_embedded_only", "SELECT vec_id FROM embeddings WHERE vec_id % 13 <> 0")
def _(t: Inputs):
    return with_gaps(t).where(F.col("embedding").isNotNull()).select("vec_id")


@check("b15_found_on", f"WITH {MATCHED} SELECT {IDS_SQL} FROM merged WHERE list_contains(found_on, 'A')")
def _(t: Inputs):
    return merged(t).where(filters.found_on("A")).select(*IDS)


@check("b16_first_spellings", """
SELECT p_partkey, v AS value FROM (SELECT p_partkey, v, row_number() OVER (PARTITION BY lower(v) ORDER BY p_partkey) AS rn
  FROM (SELECT p_partkey, trim(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' WHEN 2 THEN p_name || ' '
    ELSE p_brand END) AS v FROM part) WHERE v <> '') WHERE rn = 1""")
def _(t: Inputs):
    i = F.col("p_partkey")
    value = (F.when(i % 4 == 0, F.upper("p_name")).when(i % 4 == 1, "  ").when(i % 4 == 2, F.concat("p_name", F.lit(" ")))
             .otherwise(F.col("p_brand")))
    return first_spellings(t.part.select("p_partkey", value.alias("value")), "value", ["p_partkey"])


@check("b16_clean_values", """
SELECT p_partkey, trim(p_name) AS value FROM part WHERE p_partkey % 4 <> 1""")
def _(t: Inputs):
    value = F.when(F.col("p_partkey") % 4 != 1, F.concat(F.lit(" "), "p_name"))
    return first_spellings(t.part.select("p_partkey", value.alias("value")), "value", ["p_partkey"], dedupe=False)


@check("b17_key_integrity", f"""
WITH {MATCHED}, k AS (SELECT {KEY_SQL} AS key, count(*) AS n FROM merged GROUP BY 1)
SELECT key, n FROM k WHERE n > 1""")
def _(t: Inputs):
    return duplicated_keys(keyed(t))


# Queries of a portfolio; blanks and repeats are cleaned away.
PORTFOLIO = ["the re", " En le ", "tion", "die", "of THE", "que"]
PORTFOLIO_SQL = "(VALUES " + ", ".join(
    f"({i}, '{'_'.join(q.lower().split())}', '{q.strip()}')" for i, q in enumerate(PORTFOLIO)) + \
    ") AS f(query_ord, search_label, search_query)"


@check("b18_keyword_hits", f"""
WITH {DOCS} SELECT key, query_ord, search_label, search_query FROM p JOIN {PORTFOLIO_SQL}
ON contains(lower(title || chr(10) || description), lower(search_query))""")
def _(t: Inputs):
    hits = filters.keyword_hits(doc_postings(t), [q.strip() for q in PORTFOLIO])
    return hits.select("key", "query_ord", "search_label", "search_query")


@check("b19_posted_within", """
SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' - 14""")
def _(t: Inputs):
    df = t.events.select("event_id", F.to_date("ts").alias("posted_at"))
    return filters.posted_within(df, "14", dt.datetime(2024, 1, 20, 8)).select("event_id")


@check("b20_facets", f"""
WITH {LISTINGS} SELECT l_orderkey, l_linenumber FROM l
WHERE lower(employment_type) IN ('promo', 'small') AND contains(lower(employer_name), '1')
  AND (contains(lower(country), 'america') OR contains(lower(country), 'east'))
  AND coalesce(try_cast(salary AS DOUBLE), 1e18) >= 20000""")
def _(t: Inputs):
    return filters.facets(listings(t), employment_types=["Promo", "small"], company="1", regions=["America", "EAST"],
                          min_salary=20000).select("l_orderkey", "l_linenumber")


@check("b20_worldwide_only", f"WITH {DOCS} SELECT key FROM p WHERE country IS NULL")
def _(t: Inputs):
    return filters.facets(doc_postings(t), worldwide_only=True).select("key")


# -- joins -----------------------------------------------------------------------

@check("c1_found_on_join", f"""
WITH {MATCHED} SELECT e_ AS employer, t_ AS title, c_ AS city, array_to_string(found_on, ',') AS found_on FROM provenance""")
def _(t: Inputs):
    from ..functions.text import match_text

    # The join form: only the unmerged columns of keyed rows are needed here.
    return merged(t).where(has_match_parts()).select(
        match_text(F.col("employer_name")).alias("employer"), match_text(F.col("title")).alias("title"),
        match_text(F.col("city")).alias("city"), joined("found_on"))


HITS = LABEL_QUERIES + f""",
hits AS (SELECT * FROM (SELECT query_id, 'd' || vec_id AS key, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY query_id
  ORDER BY {CUT_SQL} DESC, 'd' || vec_id) AS rank FROM embeddings, q) WHERE rank <= 20)
"""


def hits_of(t: Inputs, k: int = 20):
    return nearest.search(vector_index(t), label_queries(t), k)


@check("c2_rows_of_hits", f"""
WITH {HITS}, {DOCS} SELECT query_id, rank, key, title, n_chars FROM hits JOIN p USING (key)""")
def _(t: Inputs):
    return joins.rows_of_hits(hits_of(t), doc_postings(t)).select("query_id", "rank", "key", "title", "n_chars")


@check("c3_candidate_join", f"""
WITH {SCORED} SELECT key, CASE WHEN lower(decision) = 'reject' THEN -999 ELSE candidate_score END AS candidate_score FROM s""")
def _(t: Inputs):
    kept = stored_verdicts(t, PRESCREEN, "prescreen").where(filters.not_rejected(F.col("decision"))).select("key")
    c = stored_verdicts(t, CANDIDATE, "candidate").withColumn("candidate_score", candidate_score())
    c = joins.only_keys(c, kept)
    return doc_postings(t).select("key").join(c, "key", "left").select(
        "key", F.coalesce("candidate_score", F.lit(-999)).alias("candidate_score"))


@check("c4_recruiter_join", f"""
WITH {SCORED} SELECT key, title, candidate_score, recruiter_score, {', '.join(RECRUITER_WEIGHTS)},
  CASE WHEN failed THEN '' ELSE 'ok' END AS recruiter_notes FROM s JOIN (SELECT doc_id, 'Posting ' || doc_id AS title
  FROM documents) USING (doc_id)""")
def _(t: Inputs):
    return match_table(t).select("key", "title", "candidate_score", "recruiter_score", *RECRUITER_WEIGHTS, "recruiter_notes")


@check("c5_only_keys", f"WITH {DOCS} SELECT key, title FROM p WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def _(t: Inputs):
    return joins.only_keys(doc_postings(t), vector_index(t)).select("key", "title")


@check("c6_not_indexed", f"WITH {DOCS} SELECT key FROM p WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t: Inputs):
    return to_embed(doc_postings(t), vector_index(t)).select("key")


@check("c7_cache_split", f"""
WITH {VERDICTS} SELECT key, NOT (undecided OR doc_id % 2 = 1) AS reused FROM r""")
def _(t: Inputs):
    cache = verdicts_of(t, PRESCREEN, "prescreen").join(
        doc_postings(t).where("doc_id % 2 = 0").select("key"), "key", "left_semi")
    reused, pending = joins.split_by_cache(doc_postings(t).select("key"), cache, ["key"])
    return reused.select("key", F.lit(True).alias("reused")).unionByName(pending.select("key", F.lit(False).alias("reused")))


NEIGHBOURS = """
SELECT * FROM (SELECT 'd' || b.vec_id AS query_id, 'd' || a.vec_id AS key,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])), 12) DESC, 'd' || a.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 10"""


@check("c9_similarity_join", NEIGHBOURS)
def _(t: Inputs):
    every = vector_index(t).select(F.col("key").alias("query_id"), "embedding")
    return nearest.search(vector_index(t), every, 10)


@check("c10_scoped_search", f"""
WITH {LABEL_QUERIES}, {DOCS} SELECT * FROM (SELECT query_id, key, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY query_id
  ORDER BY {CUT_SQL} DESC, key) AS rank FROM embeddings JOIN p ON vec_id = doc_id, q WHERE p.city = 'en') WHERE rank <= 10""")
def _(t: Inputs):
    english = filters.metadata_filter(doc_postings(t), city="en")
    return nearest.search(vector_index(t), label_queries(t), 10, scope=english)


@check("c10_large_scope", f"""
WITH {LABEL_QUERIES}, {DOCS} SELECT * FROM (SELECT query_id, key, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY query_id
  ORDER BY {CUT_SQL} DESC, key) AS rank FROM embeddings JOIN p ON vec_id = doc_id, q WHERE p.city <> 'en') WHERE rank <= 10""")
def _(t: Inputs):
    """The way for scopes too long to broadcast as keys."""
    return nearest.search(vector_index(t), label_queries(t), 10, scope=doc_postings(t).where("city <> 'en'"), small_rows=10)


# -- aggregates --------------------------------------------------------------------

@check("d1_merge_across_sources", f"""
WITH {MATCHED} SELECT {ORDER_SQL.replace('l_shipdate', "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate")}, title, employer_name,
  city, array_to_string(found_on, ',') AS found_on FROM merged""")
def _(t: Inputs):
    return merged(t).select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c == "l_shipdate" else c for c in ORDER],
                            "title", "employer_name", "city", joined("found_on"))


@check("d2_keep_first_normalised", f"WITH {MATCHED} SELECT {IDS_SQL}, l_returnflag, title FROM keyed WHERE rn = 1")
def _(t: Inputs):
    from ..functions.text import match_text

    df = listings(t).where(has_match_parts())
    parts = ["employer_name", "title", "city"]
    shadow = df.select("*", *[match_text(F.col(c)).alias(f"_{c}") for c in parts])
    return keep_first(shadow, ORDER, by=[f"_{c}" for c in parts]).select(*IDS, "l_returnflag", "title")


@check("d3_keep_first_raw", f"""
WITH {LISTINGS}, c AS (SELECT *, row_number() OVER (PARTITION BY employer_name, title, nullif(city, '')
  ORDER BY {ORDER_SQL}) AS rn FROM l) SELECT {IDS_SQL}, title, coalesce(nullif(city, ''), 'none') AS city FROM c WHERE rn = 1""")
def _(t: Inputs):
    df = listings(t).withColumn("city", F.nullif(F.col("city"), F.lit(""))).withColumn("search_label", F.lit("x"))
    return keep_first(df, ORDER, drop=("search_label",)).select(*IDS, "title", F.coalesce("city", F.lit("none")).alias("city"))


@check("d4_ingest_summary", f"""
WITH {MATCHED} SELECT actor AS label, count(*) AS rows FROM l GROUP BY 1
UNION ALL SELECT 'raw total', count(*) FROM l UNION ALL SELECT 'unique total', count(*) FROM merged""")
def _(t: Inputs):
    return summary.ingest_summary(listings(t), merged(t), "actor")


@check("d4_ingest", f"""
WITH {MATCHED} SELECT actor AS label, count(*) AS rows FROM l GROUP BY 1
UNION ALL SELECT 'raw total', count(*) FROM l UNION ALL SELECT 'unique total', count(*) FROM merged""")
def _(t: Inputs):
    """The counts that fall out of landing and merging."""
    rows = listings(t).select("title", "employer_name", "city", "source_platform", "platform_url", "description", "actor",
                              F.concat_ws("-", *ORDER).alias("row_ord"))
    frames = {name: rows.where(F.col("actor") == name) for name in ("F", "O")}
    return ingest(frames, scratch_path(t.spark, "ingest"))[1]


@check("d5_cache_ratio", f"""
WITH {VERDICTS} SELECT 'prescreen' AS pass, count(*) FILTER (WHERE NOT undecided) AS reused, count(*) AS rows FROM r""")
def _(t: Inputs):
    v = verdicts_of(t, PRESCREEN, "prescreen").withColumn("pass", F.lit("prescreen"))
    return summary.cache_ratio(v, F.col("error").isNull())


@check("d6_dropped_keys", "SELECT 'd' || vec_id AS key FROM embeddings WHERE vec_id % 13 = 0")
def _(t: Inputs):
    return summary.dropped_rows(with_gaps(t))


@check("d6_dropped_count", "SELECT count(*) AS dropped FROM embeddings WHERE vec_id % 13 = 0")
def _(t: Inputs):
    return summary.dropped_rows(with_gaps(t)).agg(F.count(F.lit(1)).alias("dropped"))


@check("d7_coverage", """
SELECT bool_and(vec_id IN (SELECT doc_id FROM documents)) AS all_known, count(*) AS hits FROM embeddings""")
def _(t: Inputs):
    return summary.coverage(vector_index(t).select("key"), doc_postings(t))


@check("d8_context", f"""
WITH {HITS}, {DOCS} SELECT query_id, string_agg('Title: ' || title || chr(10) || 'Company: ' || employer_name || chr(10) ||
  'Location: ' || city || ', ' || coalesce(country, 'None') || chr(10) || 'Posted: ' || strftime(posted_at, '%y/%m/%d') ||
  chr(10) || 'Description: ' || description, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN p USING (key) GROUP BY query_id""")
def _(t: Inputs):
    return contexts(hits_of(t), doc_postings(t))


COMBINED = SCORED + """,
b AS (SELECT min(recruiter_score) lr, max(recruiter_score) hr, min(candidate_score) lc, max(candidate_score) hc FROM s),
m AS (SELECT s.*, (recruiter_score - lr) / CAST(hr - lr AS DOUBLE) AS recr, (candidate_score - lc) / CAST(hc - lc AS DOUBLE) AS cand
  FROM s, b)
"""


@check("d9_rescale", f"WITH {COMBINED} SELECT key, round(recr, 6) AS recr, round(cand, 6) AS cand FROM m")
def _(t: Inputs):
    return summary.with_combined_score(match_table(t)).select(
        "key", F.round("recr_rescaled", 6).alias("recr"), F.round("cand_rescaled", 6).alias("cand"))


@check("h31_weighted_mean", f"WITH {COMBINED} SELECT key, round((recr * 0.6 + cand * 0.4) / 1.0, 6) AS combined FROM m")
def _(t: Inputs):
    return summary.with_combined_score(match_table(t)).select("key", F.round("combined_score", 6).alias("combined"))


@check("d10_duplicate_report", f"""
WITH {MATCHED}, k AS (SELECT *, {KEY_SQL} AS key FROM merged), c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM k)
SELECT key, title, employer_name, city, array_to_string(found_on, ',') AS found_on FROM c WHERE n > 1""")
def _(t: Inputs):
    stored = settle(with_keys(merge_across_sources(listings(t), ORDER, counted=True)))
    return duplicate_report(stored).withColumn("found_on", F.array_join("found_on", ","))


# -- ranks and cuts ------------------------------------------------------------------

@check("f1_top_k_one", """
WITH v AS (SELECT arg_min(embedding, vec_id) AS q_emb FROM embeddings)
SELECT 'd' || vec_id AS key, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q_emb AS DOUBLE[])), 6) AS score
FROM embeddings, v ORDER BY round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q_emb AS DOUBLE[])), 12) DESC, key LIMIT 25""")
def _(t: Inputs):
    first = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return nearest.search_one(vector_index(t), first, 25)


@check("f1_top_k_queries", f"WITH {HITS} SELECT query_id, rank, key, score FROM hits")
def _(t: Inputs):
    return hits_of(t)


@check("f1_top_k_blocks", NEIGHBOURS)
def _(t: Inputs):
    """The way for query tables too large to broadcast."""
    every = vector_index(t).select(F.col("key").alias("query_id"), "embedding")
    return nearest.search(vector_index(t), every, 10, block_bytes=200_000)


def two_spellings(t: Inputs):
    """Every vector under two keys, and once more a little longer: equal to six digits, not to twelve."""
    longer = F.transform("embedding", lambda x: (x.cast("double") * 1.0000001).cast("float"))
    copies = [t.embeddings.select(F.concat(F.lit(k), "vec_id").alias("key"), v.alias("embedding"))
              for k, v in (("d", F.col("embedding")), ("c", F.col("embedding")), ("z", longer))]
    return copies[0].unionByName(copies[1]).unionByName(copies[2])


@check("f1_top_k_near_ties", f"""
WITH {LABEL_QUERIES}, a AS (SELECT 'd' || vec_id AS key, embedding FROM embeddings UNION ALL SELECT 'c' || vec_id, embedding FROM embeddings
  UNION ALL SELECT 'z' || vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * CAST(1.0000001 AS DOUBLE) AS FLOAT)) FROM embeddings)
SELECT * FROM (SELECT query_id, key, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {CUT_SQL} DESC, key) AS rank
  FROM a, q) WHERE rank <= 8""")
def _(t: Inputs):
    return nearest.search(two_spellings(t), label_queries(t), 8)


@check("f1_top_k_bad_vectors", f"""
WITH {LABEL_QUERIES}, a AS (SELECT * FROM embeddings WHERE vec_id % 7 > 3)
SELECT * FROM (SELECT query_id, 'd' || vec_id AS key, {SCORE_SQL} AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY {CUT_SQL} DESC, 'd' || vec_id) AS rank FROM a, q WHERE label <> 3) WHERE rank <= 10""".replace(
    "WHERE label <> 3", "WHERE q.label <> 3"))
def _(t: Inputs):
    """Vectors that are null or hold a null, a NaN or an infinite item, on both sides."""
    def with_first(x):
        return F.concat(F.array(x.cast("float")), F.slice("embedding", 2, 1000))

    i = F.col("vec_id") % 7
    spoilt = (F.when(i > 3, F.col("embedding")).when(i == 0, with_first(F.lit(None))).when(i == 1, with_first(F.lit(float("nan"))))
              .when(i == 2, with_first(F.lit(float("-inf")))))
    asked = label_queries(t).withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")).otherwise(with_first(F.lit(float("nan")))))
    return nearest.search(vector_index(t).withColumn("embedding", spoilt), asked, 10)


@check("f1_metadata", f"""
WITH {LABEL_QUERIES}, {DOCS} SELECT * FROM (SELECT query_id, key, {SCORE_SQL} AS score, city, row_number() OVER (
  PARTITION BY query_id ORDER BY {CUT_SQL} DESC, key) AS rank FROM embeddings JOIN p ON vec_id = doc_id, q WHERE city = 'de') WHERE rank <= 10""")
def _(t: Inputs):
    """A filter on what the index itself carries, and that with the hits."""
    from ..functions.keys import metadata

    posts = doc_postings(t)
    rows = vector_index(t).join(posts.select("key", metadata(["city", "country"]).alias("metadata")), "key")
    hits = nearest.search(filters.in_metadata(rows, city="de", country=None), label_queries(t), 10, columns=("metadata",))
    return hits.select("query_id", "rank", "key", "score", F.col("metadata")["city"].alias("city"))


@check("f2_top_percent", f"""
WITH {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY recruiter_score DESC, doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM s)
SELECT key, lang, recruiter_score FROM c WHERE rn <= greatest(1, round_even(n * 30 / 100.0, 0))""")
def _(t: Inputs):
    v = stored_verdicts(t, RECRUITER, "recruiter").withColumn("recruiter_score", recruiter_score())
    v = v.join(replies(t).select("key", "lang", "doc_id"), "key")
    return ranking.top_percent(v, 30, [F.desc("recruiter_score"), F.asc("doc_id")], ["lang"], score="recruiter_score").select(
        "key", "lang", "recruiter_score")


@check("f2_hot_group", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS score,
             CASE WHEN l_orderkey % 10 < 9 THEN 'hot' WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS g FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
  count(*) OVER (PARTITION BY g) AS n FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(g, 'none') AS g FROM c WHERE rn <= greatest(1, round_even(n * 10 / 100.0, 0))""")
def _(t: Inputs):
    """One group with nine tenths of the rows, scores that hardly repeat, a null group."""
    n = F.col("l_orderkey") % 10
    rows = t.lineitem.select(*IDS, F.col("l_extendedprice").alias("score"),
                             F.when(n < 9, "hot").when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("g"))
    kept = ranking.top_percent(rows, 10, [F.desc("score"), *[F.asc(c) for c in IDS]], ["g"], score="score")
    return kept.select(*IDS, F.coalesce("g", F.lit("none")).alias("g"))


@check("f3_final_rank", f"""
WITH {SCORED} SELECT key, candidate_score, recruiter_score,
  row_number() OVER (ORDER BY candidate_score DESC, recruiter_score DESC, key) AS rank FROM s""")
def _(t: Inputs):
    return ranking.global_rank(match_table(t).select("key", "candidate_score", "recruiter_score"),
                               [*ranking.final_order(), F.asc("key")])


@check("f4_rescored_rank", f"""
WITH {VERDICTS}, s AS (SELECT key, {recruiter_sql(SCREEN_WEIGHTS)} AS recruiter_score,
  {candidate_sql(CANDIDATE_WEIGHTS)} AS candidate_score FROM r)
SELECT *, row_number() OVER (ORDER BY recruiter_score DESC, candidate_score DESC, key) AS rank FROM s""")
def _(t: Inputs):
    from ..plans.match import rescore

    scored = rescore(match_table(t), SCREEN_WEIGHTS, CANDIDATE_WEIGHTS).select("key", "recruiter_score", "candidate_score")
    return ranking.global_rank(scored, [*ranking.rescored_order(), F.asc("key")])


@check("f5_combined_rank", f"""
WITH {COMBINED}, c AS (SELECT key, round((recr * 0.6 + cand * 0.4) / 1.0, 6) AS combined FROM m WHERE recruiter_score >= 40)
SELECT *, row_number() OVER (ORDER BY combined DESC, key) AS rank FROM c""")
def _(t: Inputs):
    scored = filters.at_least(summary.with_combined_score(match_table(t)), "recruiter_score", 40)
    return ranking.global_rank(scored.select("key", F.round("combined_score", 6).alias("combined")),
                               [F.desc("combined"), F.asc("key")])


@check("f6_first_remote", """
SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 500""")
def _(t: Inputs):
    remote = t.events.where(filters.is_remote(F.col("event_type") == "click", F.array().cast("array<string>")))
    return ranking.top_k(remote, [F.asc("ts"), F.asc("event_id")], 500).select("event_id", "event_type")


@check("h36_run_id", """
SELECT event_id, coalesce(nullif(lower(trim(regexp_replace(event_type || ' / ' || user_id || CASE WHEN event_id % 3 = 0 THEN ':Q4_K' ELSE '.' END,
    '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'x') || '__n' || event_id % 300 || '__keep'
  || CASE event_id % 4 WHEN 0 THEN '30' WHEN 1 THEN '12.5' WHEN 2 THEN '100' ELSE '0.25' END || '__' || strftime(ts, '%Y%m%d-%H%M%S') AS run_id
FROM events""")
def _(t: Inputs):
    i = F.col("event_id")
    model = F.concat("event_type", F.lit(" / "), "user_id", F.when(i % 3 == 0, ":Q4_K").otherwise("."))
    keep = F.when(i % 4 == 0, 30.0).when(i % 4 == 1, 12.5).when(i % 4 == 2, 100.0).otherwise(0.25)
    return t.events.select("event_id", tables.run_id_column(model, i % 300, keep, F.col("ts").cast("timestamp")).alias("run_id"))


@check("f7_recent_runs", """
SELECT 'run-' || user_id AS run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS started
FROM events GROUP BY user_id ORDER BY max(ts) DESC, run_id DESC LIMIT 5""")
def _(t: Inputs):
    path = scratch_path(t.spark, "runs")
    runs = t.events.groupBy(F.concat(F.lit("run-"), "user_id").alias("run_id")).agg(
        F.max("ts").cast("timestamp").alias("started_at"))
    runs.write.parquet(f"{path}/runs")
    return tables.recent_runs(t.spark, path, 5).select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"))


# -- sets -----------------------------------------------------------------------------

@check("g1_union_sources", f"""
WITH {LISTINGS} SELECT l_returnflag AS actor, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_ord,
  title, city, CASE WHEN l_returnflag = 'A' THEN '' ELSE category END AS category, count(*) AS rows FROM l GROUP BY ALL""")
def _(t: Inputs):
    df = listings(t).select("l_returnflag", "title", "city", "category")
    frames = {f: df.where(F.col("l_returnflag") == f).drop(*(["category"] if f == "A" else [])) for f in ("A", "N", "R")}
    return union_sources(frames).groupBy("actor", "source_ord", "title", "city",
                                         F.coalesce("category", F.lit("")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"))


@check("g2_union_unkeyed", f"""
WITH {MATCHED} SELECT city = '' AS unkeyed, count(*) AS rows, count(DISTINCT title) AS titles FROM merged GROUP BY 1""")
def _(t: Inputs):
    return merged(t).groupBy((F.col("city") == "").alias("unkeyed")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("title").alias("titles"))


@check("g3_scope", "SELECT 'd' || doc_id AS key FROM documents INTERSECT SELECT 'd' || vec_id FROM embeddings")
def _(t: Inputs):
    return joins.key_intersection(doc_postings(t), vector_index(t))


@check("g4_to_embed", "SELECT 'd' || doc_id AS key FROM documents EXCEPT SELECT 'd' || vec_id FROM embeddings")
def _(t: Inputs):
    return joins.key_difference(doc_postings(t), vector_index(t))


@check("g5_sorted_distinct", """
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS flags
FROM lineitem GROUP BY l_orderkey""")
def _(t: Inputs):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(
        F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("flags"))
