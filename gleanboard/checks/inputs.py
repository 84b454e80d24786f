"""Posting-like tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .registry import Inputs

NOW = dt.datetime(2026, 5, 20, 1, 0)
NOW_SQL = "TIMESTAMP '2026-05-20 01:00:00'"

# A total order over lineitem, used wherever the first row wins.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
         "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag"]
ORDER_SQL = ", ".join(ORDER)
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
IDS_SQL = ", ".join(IDS)


def listings(t: Inputs) -> DataFrame:
    """lineitem as job listings with noisy titles, blank cities and sources."""
    n = F.col("l_linenumber")
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            *ORDER,
            F.when(n % 3 == 0, F.upper("p_name")).when(n % 3 == 1, F.concat(F.lit("  "), "p_name"))
            .otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("   "))).alias("title"),
            F.col("s_name").alias("employer_name"),
            F.when(n == 7, "").otherwise(F.col("n_name")).alias("city"),
            F.col("r_name").alias("country"),
            F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("source_platform"),
            F.col("l_linestatus").alias("actor"),
            F.when(n != 3, F.to_date("l_shipdate")).alias("posted_at"),
            F.when(n != 5, F.concat(F.lit("https://jobs.example/"), "l_partkey")).alias("platform_url"),
            F.col("p_type").alias("employment_type"),
            F.col("p_brand").alias("category"),
            F.when(n % 2 == 0, F.col("l_extendedprice").cast("string")).otherwise("negotiable").alias("salary"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        ))


LISTINGS = """
l AS (
  SELECT lineitem.*,
    CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name
      ELSE replace(p_name, ' ', '   ') END AS title,
    s_name AS employer_name,
    CASE WHEN l_linenumber = 7 THEN '' ELSE n_name END AS city,
    r_name AS country,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS source_platform,
    l_linestatus AS actor,
    CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS posted_at,
    CASE WHEN l_linenumber <> 5 THEN 'https://jobs.example/' || l_partkey END AS platform_url,
    p_type AS employment_type, p_brand AS category,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS VARCHAR) ELSE 'negotiable' END AS salary,
    p_name || ' ' || p_brand || ' ' || p_type AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def squeezed(column: str) -> str:
    """SQL of the match-key form of a text column."""
    return rf"trim(regexp_replace(lower({column}), '[\s\p{{Z}}]+', ' ', 'g'))"


# Listings with the match-key parts and the effective source.
MATCHED = LISTINGS + f""",
n AS (SELECT l.*, {squeezed('title')} AS t_, {squeezed('employer_name')} AS e_, {squeezed('city')} AS c_,
        coalesce(nullif(source_platform, ''), actor) AS src FROM l),
keyed AS (SELECT *, row_number() OVER (PARTITION BY e_, t_, c_ ORDER BY {ORDER_SQL}) AS rn
          FROM n WHERE e_ <> '' AND t_ <> '' AND c_ <> ''),
provenance AS (SELECT e_, t_, c_, list_sort(list(DISTINCT src)) AS found_on FROM keyed GROUP BY e_, t_, c_),
merged AS (
  SELECT keyed.* EXCLUDE (rn), found_on FROM keyed JOIN provenance USING (e_, t_, c_) WHERE rn = 1
  UNION ALL BY NAME
  SELECT n.*, [src] AS found_on FROM n WHERE NOT (e_ <> '' AND t_ <> '' AND c_ <> ''))
"""
KEY_SQL = """substr(sha1(array_to_string(found_on, ' ') || '|' || coalesce(platform_url, 'None') || '|' ||
  coalesce(title, 'None') || '|' || coalesce(employer_name, '')), 1, 32)"""


def doc_postings(t: Inputs) -> DataFrame:
    """documents as postings with a key."""
    return t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("key"), F.concat(F.lit("Posting "), "doc_id").alias("title"),
        F.col("source").alias("employer_name"), F.col("lang").alias("city"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.upper("lang")).alias("country"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 140).cast("int")).alias("posted_at"),
        F.col("text").alias("description"), "doc_id", "lang", "source", "n_chars")


DOCS = """
p AS (SELECT 'd' || doc_id AS key, 'Posting ' || doc_id AS title, source AS employer_name, lang AS city,
        CASE WHEN doc_id % 4 <> 0 THEN upper(lang) END AS country,
        DATE '2026-01-01' + CAST(doc_id % 140 AS INTEGER) AS posted_at, text AS description,
        doc_id, lang, source, n_chars FROM documents)
"""


def vector_index(t: Inputs) -> DataFrame:
    return t.embeddings.select(F.concat(F.lit("d"), "vec_id").alias("key"), "embedding", "vec_id", "label")


def label_queries(t: Inputs) -> DataFrame:
    """One query per label: its first vector."""
    return t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.concat(F.lit("p"), "label").alias("query_id"), "embedding", "label")


LABEL_QUERIES = """
q AS (SELECT 'p' || label AS query_id, label, arg_min(embedding, vec_id) AS q_emb FROM embeddings GROUP BY label)
"""
SCORE_SQL = "round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q_emb AS DOUBLE[])), 6)"
CUT_SQL = SCORE_SQL.replace(", 6)", ", 12)")

RATING_FACTORS = {"technical_match": 3, "seniority_match": 5, "transferability": 7, "trajectory": 11,
                  "soft_skills": 13}
# What a model looks for in a text, per verdict list.
LOOKED_FOR = {"themes_matched": ["the", "la", "der"], "must_haves_met": ["and", "que"],
              "must_haves_missing": ["und", "le"], "disqualifiers_triggered": ["http", "@"]}


def _rating(name: str) -> Column:
    return F.pmod(F.col("doc_id") * F.lit(RATING_FACTORS[name]) + F.col("n_chars"), F.lit(11))


def replies(t: Inputs) -> DataFrame:
    """What a model would have returned for every document, faults included.

    By doc_id: a quoted number, a fraction, a number above the scale, a missing
    field and a truth value for the first rating; trailing commas and single
    quotes in the JSON; a failed call now and then.
    """
    i = F.col("doc_id")
    first = _rating("technical_match")
    first_json = (F.when(i % 9 == 0, F.concat(F.lit('"'), first.cast("string"), F.lit('"')))
                  .when(i % 9 == 1, F.concat(first.cast("string"), F.lit(".9")))
                  .when(i % 9 == 2, F.lit("12")).when(i % 9 == 4, F.lit("true")).otherwise(first.cast("string")))
    head = F.when(i % 9 == 3, F.lit("")).otherwise(F.concat(F.lit('"technical_match": '), first_json, F.lit(", ")))
    rest = F.concat_ws(", ", *[F.concat(F.lit(f'"{r}": '), _rating(r).cast("string"))
                               for r in list(RATING_FACTORS)[1:]])
    tail = F.when(i % 5 == 0, F.lit(",}")).otherwise(F.lit("}"))
    recruiter = F.concat(F.lit("{"), head, rest, F.lit(', "recruiter_notes": "ok"'), tail)
    recruiter = F.when(i % 7 == 0, F.replace(recruiter, F.lit('"'), F.lit("'"))).otherwise(recruiter)

    def hits(words: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("low"), w))

    candidate = F.to_json(F.struct(*[hits(w).alias(n) for n, w in LOOKED_FOR.items()]))
    word = F.when(i % 11 == 0, "reject").when(i % 11 == 1, "Reject").when(i % 11 == 2, "maybe").otherwise("PASS")
    prescreen = F.when(i % 11 == 3, '{"decision": 1}').otherwise(
        F.concat(F.lit('{"decision": "'), word, F.lit('"}')))
    return (t.documents.withColumn("low", F.lower("text"))
            .select("doc_id", F.concat(F.lit("d"), "doc_id").alias("key"), "lang", "source", "n_chars",
                    recruiter.alias("recruiter"), candidate.alias("candidate"), prescreen.alias("prescreen"),
                    F.when(i % 37 == 0, "timeout").alias("call_error")))


def _rating_sql(name: str) -> str:
    return f"((doc_id * {RATING_FACTORS[name]} + n_chars) % 11)"


def _looked_for_sql(words: list[str]) -> str:
    return f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(lower(text), w))"


def recruiter_sql(weights: dict[str, float]) -> str:
    terms = " + ".join(f"CAST({w!r} AS DOUBLE) * {n}" for n, w in weights.items())
    return f"CAST(round_even(CAST(100.0 AS DOUBLE) * ({terms}) / CAST({10 * sum(weights.values())!r} AS DOUBLE), 0) AS INTEGER)"


def candidate_sql(weights: dict[str, float]) -> str:
    return "CAST(" + " + ".join(f"{w} * len({n})" for n, w in weights.items()) + " AS INTEGER)"


VERDICTS = f"""
r AS (SELECT doc_id, 'd' || doc_id AS key, lang, source, n_chars,
  doc_id % 37 = 0 AS failed,
  CAST(CASE WHEN failed THEN 0 ELSE CASE doc_id % 9 WHEN 0 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 0 WHEN 4 THEN 1
    ELSE {_rating_sql('technical_match')} END END AS INTEGER) AS technical_match,
  {', '.join(f"CAST(CASE WHEN failed THEN 0 ELSE {_rating_sql(r)} END AS INTEGER) AS {r}"
             for r in list(RATING_FACTORS)[1:])},
  {', '.join(f"CASE WHEN failed THEN [] ELSE {_looked_for_sql(w)} END AS {n}" for n, w in LOOKED_FOR.items())},
  CASE WHEN failed THEN '' ELSE CASE doc_id % 11 WHEN 0 THEN 'reject' WHEN 1 THEN 'Reject'
    WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'PASS' END END AS decision,
  failed OR doc_id % 11 IN (2, 3) AS undecided
  FROM documents)
"""


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def joined_sql(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"
