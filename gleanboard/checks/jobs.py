"""Checks of the model passes, the index, the streams and the whole jobs.

The model here is a deterministic function of the message, so that SQL can
compute what a run must give.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ..functions.scores import CANDIDATE_WEIGHTS, RECRUITER_WEIGHTS
from ..functions.keys import match_key
from ..operators import nearest
from ..operators.dedupe import merge_across_sources
from ..operators.passes import CANDIDATE, PRESCREEN, RECRUITER, ModelStopped, ask_model, score_pass
from ..operators.ranking import global_rank, rank_within, rescored_order
from ..plans import collect, index as indexing
from ..plans.ask import ask, prompts
from ..plans.match import MatchSettings, Models, code_profiles, match, rescore, rescored_preview
from ..plans.stored_pass import RunStore, stored_pass
from ..schemas import THEME_LISTS
from ..session import scratch_path, settle
from ..sources import tables
from ..sources.boards import read_board
from ..streaming.first_wins import ProvenanceLog, first_by_key
from ..streaming.incremental_index import index_stream
from ..streaming.ingest import landing_lines, landing_stream, ordered_postings, write_postings
from .boards import ALLJOBS_SQL, _alljobs, _xing, shown
from .expressions import SCREEN_WEIGHTS
from .inputs import (DOCS, IDS, IDS_SQL, KEY_SQL, LABEL_QUERIES, LISTINGS, MATCHED, NOW, ORDER, ORDER_SQL, CUT_SQL, SCORE_SQL,
                     VERDICTS, candidate_sql, doc_postings, joined, joined_sql, label_queries, listings, recruiter_sql,
                     vector_index)
from .registry import Inputs, check
from .tables import PORTFOLIO, PORTFOLIO_SQL, match_table

# -- the stand-in model --------------------------------------------------------

FACTORS = {"technical_match": 3, "seniority_match": 5, "transferability": 7, "trajectory": 11, "soft_skills": 13}
LISTS = {"themes_matched": "role_themes", "must_haves_met": "must_have_themes",
         "must_haves_missing": "nice_to_have_themes", "disqualifiers_triggered": "disqualifiers"}
WORDS = ["the", "la", "der", "and", "que", "und", "tion", "ein", "re", "os"]


def _parts(message: str) -> tuple[int, int, str]:
    """doc_id, number of the CV and description of a message."""
    posting = message[message.rindex("\n\nJOB POSTING:\n"):] if message.count("\n\nJOB POSTING:\n") == 1 else \
        message[message.index("\n\nJOB POSTING:\n"):]
    doc = int(re.search(r"Title: Posting (\d+)", posting).group(1))
    cv = re.search(r"CV (\d+)", message[:200])
    return doc, int(cv.group(1)) if cv else -1, posting[posting.index("\nDescription: ") + 14:]


def _one(message: str, failing: int, answer) -> str:
    doc, cv, description = _parts(message)
    if doc % 37 == failing:
        raise TimeoutError(f"no answer for {doc}")
    return json.dumps(answer(doc, cv, description))


def prescreen_model(messages: list[str]) -> list[str]:
    return [_one(m, 0, lambda d, cv, _: {"decision": "Reject" if (d * 7 + cv) % 5 == 0 else "pass"}) for m in messages]


def recruiter_model(messages: list[str]) -> list[str]:
    return [_one(m, 1, lambda d, cv, text: {n: (d * f + len(text) + cv) % 11 for n, f in FACTORS.items()}
                 | {"recruiter_notes": f"note {d}"}) for m in messages]


def candidate_model(messages: list[str]) -> list[str]:
    out = []
    for m in messages:
        profile = json.loads(m[len("CANDIDATE PROFILE:\n"):m.index("\n\nJOB POSTING:\n")])
        out.append(_one(m, 2, lambda d, cv, text: {n: [w for w in profile[slot] if w in text.lower()]
                                                   for n, slot in LISTS.items()}))
    return out


STAND_IN = Models(prescreen_model, recruiter_model, candidate_model)


def profiles(t: Inputs):
    """One profile per label, with themes picked by the label."""
    words = F.array(*[F.lit(w) for w in WORDS])

    def pick(*steps: int):
        return F.array(*[F.get(words, F.pmod(F.col("label") * 3 + F.lit(s), F.lit(len(WORDS))).cast("int")) for s in steps])

    return label_queries(t).select(
        F.col("query_id").alias("profile_id"), F.concat(F.lit("CV "), "label").alias("cv_text"),
        pick(0, 1, 2).alias("role_themes"), pick(3, 4).alias("must_have_themes"),
        pick(5).alias("nice_to_have_themes"), pick(6, 7).alias("disqualifiers"), F.lit("query").alias("search_query"),
        "embedding")


def _pick_sql(*steps: int) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    return "list_filter([" + ", ".join(f"{words}[CAST((label * 3 + {s}) % {len(WORDS)} AS BIGINT) + 1]" for s in steps) + \
        "], lambda w: contains(lower(text), w))"


def match_sql(top_n: int = 200, keep_pct: float = 30, where: str = "TRUE", weights=RECRUITER_WEIGHTS) -> str:
    """The cascade in SQL, up to ``final``."""
    picks = {"themes_matched": (0, 1, 2), "must_haves_met": (3, 4), "must_haves_missing": (5,), "disqualifiers_triggered": (6, 7)}
    return f"""
WITH {LABEL_QUERIES}, {DOCS},
h AS (SELECT * FROM (SELECT query_id AS profile_id, label, p.*, {SCORE_SQL} AS score, row_number() OVER (
    PARTITION BY query_id ORDER BY {CUT_SQL} DESC, key) AS hit_rank
  FROM (SELECT vec_id, embedding FROM embeddings) e JOIN p ON vec_id = doc_id, q WHERE {where}) WHERE hit_rank <= {top_n}),
screened AS (SELECT h.*, description AS text FROM h WHERE doc_id % 37 = 0 OR (doc_id * 7 + label) % 5 <> 0),
rated AS (SELECT *, {', '.join(f"CAST(CASE WHEN doc_id % 37 = 1 THEN 0 ELSE (doc_id * {f} + n_chars + label) % 11 END AS INTEGER) AS {n}"
                               for n, f in FACTORS.items())},
  CASE WHEN doc_id % 37 = 1 THEN '' ELSE 'note ' || doc_id END AS recruiter_notes FROM screened),
scored AS (SELECT *, {recruiter_sql(weights)} AS recruiter_score FROM rated),
cut AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY recruiter_score DESC, hit_rank) AS place,
  count(*) OVER (PARTITION BY profile_id) AS n FROM scored),
judged AS (SELECT *, {', '.join(f"CASE WHEN doc_id % 37 = 2 THEN [] ELSE {_pick_sql(*s)} END AS {n}" for n, s in picks.items())}
  FROM cut WHERE place <= greatest(1, round_even(n * {keep_pct} / 100.0, 0))),
final AS (SELECT *, {candidate_sql(CANDIDATE_WEIGHTS)} AS candidate_score FROM judged)
"""


MATCH_SQL = match_sql() + f"""
SELECT profile_id, key, title, recruiter_score, candidate_score, recruiter_notes, {joined_sql('themes_matched')},
  {joined_sql('disqualifiers_triggered')}, doc_id % 37 = 2 AS failed,
  row_number() OVER (PARTITION BY profile_id ORDER BY candidate_score DESC, recruiter_score DESC, key) AS rank FROM final"""


def match_rows(df):
    return df.select("profile_id", "key", "title", "recruiter_score", "candidate_score", "recruiter_notes",
                     joined("themes_matched"), joined("disqualifiers_triggered"),
                     F.col("error").isNotNull().alias("failed"), "rank")


def run_match(t: Inputs, models: Models = STAND_IN, **options):
    return match(profiles(t), doc_postings(t), vector_index(t).select("key", "embedding"), models, now=NOW, **options)


# -- passes ---------------------------------------------------------------------

def _rows(t: Inputs):
    """Every document against one CV, as the messages of a pass."""
    from ..functions.text import cv_message, posting_text

    return doc_postings(t).select(F.lit("p1").alias("profile_id"), "key",
                                  cv_message(F.lit("CV 1"), posting_text(), NOW).alias("message"))


@check("i4_score_pass", f"""
WITH {DOCS} SELECT key, NOT (doc_id % 3 = 0 AND doc_id % 37 <> 0) AS fresh, doc_id % 37 = 0 AS failed,
  CASE WHEN doc_id % 37 = 0 THEN '' WHEN (doc_id * 7 + 1) % 5 = 0 THEN 'Reject' ELSE 'pass' END AS decision FROM p""")
def _(t: Inputs):
    rows = _rows(t)
    first = settle(score_pass(rows, prescreen_model, PRESCREEN, concurrency=8))
    cache = first.drop("cached").join(doc_postings(t).where("doc_id % 3 = 0").select("key"), "key", "left_semi")
    again = score_pass(rows, prescreen_model, PRESCREEN, cache=cache, concurrency=8)
    return again.select("key", (~F.col("cached")).alias("fresh"), F.col("error").isNotNull().alias("failed"), "decision")


@check("i5_prescreen", f"""
WITH {DOCS} SELECT key, CASE WHEN doc_id % 37 = 0 THEN '' WHEN (doc_id * 7 + 1) % 5 = 0 THEN 'Reject' ELSE 'pass' END AS decision,
  CASE WHEN doc_id % 37 = 0 THEN 'prescreen failed at key ''' || key || ''': no answer for ' || doc_id ELSE '' END AS error FROM p""")
def _(t: Inputs):
    v = score_pass(_rows(t), prescreen_model, PRESCREEN, concurrency=8)
    return v.select("key", "decision", F.coalesce("error", F.lit("")).alias("error"))


@check("i6_recruiter", f"""
WITH {DOCS} SELECT key, {', '.join(f"CAST(CASE WHEN doc_id % 37 = 1 THEN 0 ELSE (doc_id * {f} + n_chars + 1) % 11 END AS INTEGER) AS {n}"
                                   for n, f in FACTORS.items())},
  CASE WHEN doc_id % 37 = 1 THEN '' ELSE 'note ' || doc_id END AS recruiter_notes FROM p""")
def _(t: Inputs):
    return score_pass(_rows(t), recruiter_model, RECRUITER, concurrency=8).select("key", *FACTORS, "recruiter_notes")


@check("i7_candidate", f"""
WITH {DOCS}, w AS (SELECT *, description AS text, 1 AS label FROM p)
SELECT key, array_to_string(CASE WHEN doc_id % 37 = 2 THEN [] ELSE {_pick_sql(0, 1, 2)} END, ',') AS themes_matched,
  array_to_string(CASE WHEN doc_id % 37 = 2 THEN [] ELSE {_pick_sql(3, 4)} END, ',') AS must_haves_met FROM w""")
def _(t: Inputs):
    from ..functions.text import posting_text, profile_message

    one = profiles(t).where("profile_id = 'p1'").select(
        "profile_id", F.struct(*THEME_LISTS, "search_query").alias("profile"))
    rows = doc_postings(t).withColumn("profile_id", F.lit("p1")).join(F.broadcast(one), "profile_id").select(
        "profile_id", "key", profile_message(F.col("profile"), posting_text()).alias("message"))
    return score_pass(rows, candidate_model, CANDIDATE, concurrency=8).select(
        "key", joined("themes_matched"), joined("must_haves_met"))


def coding_model(texts: list[str]) -> list[str]:
    """First words of a CV as themes; an empty CV cannot be coded."""
    out = []
    for text in texts:
        words = text.split()
        out.append("{'role_themes': %s, 'must_have_themes': %s, 'disqualifiers': null, search_query: %s,}" % (
            json.dumps(words[:2]), json.dumps(words[2] if len(words) > 2 else None), json.dumps(" ".join(words[:3]))))
    return out


@check("i8_code_profiles", r"""
WITH c AS (SELECT conv_id || '/' || turn AS profile_id,
  regexp_split_to_array(trim(text, E' \n\t\r'), '[\s\p{Z}]+') AS w FROM conversations)
SELECT profile_id, array_to_string(w[1:2], '|') AS role_themes, coalesce(w[3], '') AS must_have_themes,
  array_to_string(w[1:3], ' ') AS search_query FROM c""")
def _(t: Inputs):
    cvs = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("profile_id"), F.col("text").alias("cv_text"))
    return code_profiles(cvs, coding_model).select(
        "profile_id", F.array_join("role_themes", "|").alias("role_themes"),
        F.array_join("must_have_themes", "|").alias("must_have_themes"), "search_query")


# -- embeddings --------------------------------------------------------------------

def length_embedder(texts: list[str]) -> list[list[float]]:
    """A vector on one line through the origin; refuses texts of 13 n characters."""
    if any(len(x) % 13 == 0 for x in texts):
        raise ValueError("bad text in batch")
    return [[3.0 * len(x), 0.0, -4.0 * len(x)] for x in texts]


@check("i1_embed_documents", """
SELECT doc_id, n_chars % 13 = 0 AS failed, CASE WHEN n_chars % 13 = 0 THEN 'none' ELSE '0.6,0.0,-0.8' END AS vector
FROM documents""")
def _(t: Inputs):
    df = indexing.with_embedding(t.documents.select("doc_id", "text"), "text", length_embedder)
    shown_vector = F.array_join(F.transform("embedding", lambda x: F.round(x, 5).cast("string")), ",")
    return df.select("doc_id", F.col("embedding").isNull().alias("failed"),
                     F.coalesce(shown_vector, F.lit("none")).alias("vector"))


@check("i2_embed_queries", "SELECT item_id, 64 AS dimensions, 1.0 AS norm FROM benchmark")
def _(t: Inputs):
    from ..functions.vectors import norm

    df = indexing.with_embedding(t.benchmark, "text", indexing.hashing_embedder())
    return df.select("item_id", F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 4).alias("norm"))


@check("i3_incremental_index", f"""
WITH {DOCS} SELECT key, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS run FROM p""")
def _(t: Inputs):
    """Two runs: English first, then everything; only the rest is embedded again."""
    path = scratch_path(t.spark, "index")
    embedder = indexing.hashing_embedder()
    first, _, _ = indexing.build_index(doc_postings(t).where("lang = 'en'"), path, embedder, "hash")
    seen = settle(first.select("key"))
    both, scope, _ = indexing.build_index(doc_postings(t), path, embedder, "hash")
    return both.join(scope, "key", "left_semi").join(seen.withColumn("run", F.lit("first")), "key", "left").select(
        "key", F.coalesce("run", F.lit("second")).alias("run"))


def answer_model(messages: list[str]) -> list[str]:
    return [f"{m.count('Title: Posting')} postings for {m[m.rindex('Question: ') + 10:]}" for m in messages]


def questions(t: Inputs):
    return label_queries(t).select("query_id", F.concat(F.lit("what about "), "label").alias("question"), "embedding")


ASK = f"""
WITH {LABEL_QUERIES}, {DOCS},
h AS (SELECT * FROM (SELECT query_id, label, p.*, {SCORE_SQL} AS score, row_number() OVER (PARTITION BY query_id
  ORDER BY {CUT_SQL} DESC, key) AS rank FROM (SELECT vec_id, embedding FROM embeddings) e JOIN p ON vec_id = doc_id, q
  WHERE city = 'en') WHERE rank <= 50)
"""


@check("i9_answers", ASK + "SELECT query_id, count(*) || ' postings for what about ' || label AS answer FROM h GROUP BY query_id, label")
def _(t: Inputs):
    answers, _ = ask(questions(t), doc_postings(t), vector_index(t), answer_model, city="en")
    return answers.select("query_id", "answer")


@check("k6_ask_sources", ASK + "SELECT query_id, rank, score, key, title FROM h")
def _(t: Inputs):
    _, sources = ask(questions(t), doc_postings(t), vector_index(t), answer_model, city="en")
    return sources.select("query_id", "rank", "score", "key", "title")


@check("k6_ask_prompts", ASK + """
SELECT query_id, 'Context:' || chr(10) || chr(10) || string_agg('Title: ' || title || chr(10) || 'Company: ' || employer_name || chr(10) ||
  'Location: ' || city || ', ' || coalesce(country, 'None') || chr(10) || 'Posted: ' || strftime(posted_at, '%y/%m/%d') ||
  chr(10) || 'Description: ' || description, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'Question: what about ' || label AS prompt FROM h GROUP BY query_id, label""")
def _(t: Inputs):
    from ..operators.filters import metadata_filter

    english = metadata_filter(doc_postings(t), city="en", country=None)
    hits = nearest.search(indexing.scoped(vector_index(t), english), label_queries(t), 50)
    return prompts(questions(t), hits, english)


# -- streams ------------------------------------------------------------------------

#: Rows of a landed file, narrow ones and whole texts.
FILE_ROWS, FILE_TEXTS = 250_000, 20_000


def files_a_part(rows: int, parts: int, most: int = FILE_ROWS) -> int:
    """Files for each of the equal parts in which rows land. A part is what a stream takes in
    at once or a share of it: there are as many at every size, but no task writes or reads a whole one."""
    return max(1, math.ceil(rows / parts / most))


@check("j1_landing_stream", ALLJOBS_SQL)
def _(t: Inputs):
    landing, out, marks = (scratch_path(t.spark, n) for n in ("landing", "postings", "marks"))
    _alljobs(t).repartition(4).write.text(landing)
    stream = landing_stream(t.spark, "alljobs", landing, NOW, files_per_batch=2)
    write_postings(stream, out, marks).awaitTermination()
    return shown(t.spark.read.parquet(out))


def _event_stream(t: Inputs):
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")


@check("j2_first_by_key_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Inputs):
    out, marks = scratch_path(t.spark, "first"), scratch_path(t.spark, "marks")
    stream = _event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = first_by_key(stream, "ts", ["user_id", "event_type"], "3650 days")
    (kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(out).select("user_id", "event_type")


@check("j2_provenance_stream", f"""
WITH {MATCHED} SELECT {IDS_SQL}, l_returnflag, title, array_to_string(found_on, ',') AS found_on FROM merged""")
def _(t: Inputs):
    landing, out, marks = (scratch_path(t.spark, n) for n in ("listings", "groups", "marks"))
    rows = listings(t).select(*ORDER, "title", "employer_name", "city", "source_platform", "actor")
    files = files_a_part(t.lineitem.count(), 4)
    rows.repartition(4 * files).write.parquet(landing)
    log = ProvenanceLog(out, ORDER)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(landing)
    log.start(stream, marks).awaitTermination()
    return log.read(t.spark).select(*IDS, "l_returnflag", "title", joined("found_on"))


@check("j2_generations", f"""
WITH {MATCHED} SELECT {IDS_SQL}, l_returnflag, title, array_to_string(found_on, ',') AS found_on FROM merged""")
def _(t: Inputs):
    """Many micro-batches, a generation after every third, the last one noted twice."""
    landing, out, marks = (scratch_path(t.spark, n) for n in ("listings", "groups", "marks"))
    rows = listings(t).select(*ORDER, "title", "employer_name", "city", "source_platform", "actor")
    files = files_a_part(t.lineitem.count(), 8)
    rows.repartition(8 * files).write.parquet(landing)
    log = ProvenanceLog(out, ORDER, compact_every=3)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(landing)
    log.start(stream, marks).awaitTermination()
    log.compact(t.spark, log.generation(t.spark)[0])
    return log.read(t.spark).select(*IDS, "l_returnflag", "title", joined("found_on"))


@check("j1_stream_order", """
WITH p AS (SELECT page_id, url, page_id % 50 AS job, CASE page_id % 4 WHEN 0 THEN '' ELSE 'Berlin' END AS city FROM pages)
SELECT arg_min(url, page_id) AS platform_url, 'Job ' || job AS title, city FROM p WHERE city <> '' GROUP BY job, city
UNION ALL SELECT url, 'Job ' || job, city FROM p WHERE city = ''""")
def _(t: Inputs):
    """Files of unequal size through the stream and through the batch reader: the same copies survive."""
    landing, out, marks = (scratch_path(t.spark, n) for n in ("landing", "groups", "marks"))
    job = F.col("page_id") % 50
    lines = t.pages.select("page_id", F.to_json(F.struct(
        F.col("url").alias("platform_url"), F.concat(F.lit("Job "), job).alias("title"), F.lit("Acme").alias("company_name"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise("Berlin, BE, Deutschland").alias("location"),
        F.repeat(F.lit("x"), (F.col("page_id") % 300).cast("int")).alias("description"))).alias("value"))
    lines.repartitionByRange(5, F.sqrt("page_id")).sortWithinPartitions("page_id").select("value").write.text(landing)
    log = ProvenanceLog(out, ["row_ord"], compact_every=2)
    stream = landing_lines(t.spark, landing, files_per_batch=2)
    log.start(stream, marks, ordered_postings("alljobs", NOW)).awaitTermination()
    streamed = settle(log.read(t.spark).select("platform_url", "title", "city"))
    batch = merge_across_sources(read_board(t.spark, "alljobs", landing, NOW), ["row_ord"], source=F.col("source_platform"))
    batch = settle(batch.select("platform_url", "title", "city"))
    if not (streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()):
        raise AssertionError("the stream and the batch keep different copies")
    return streamed


@check("j3_index_stream", f"WITH {DOCS} SELECT key, count(*) AS copies FROM p GROUP BY key")
def _(t: Inputs):
    landing, out, marks = (scratch_path(t.spark, n) for n in ("postings", "index", "marks"))
    rows = doc_postings(t).select("key", "title", "employer_name", "city", "country", "description")
    files = files_a_part(2 * t.documents.count(), 4, FILE_TEXTS)
    rows.unionByName(rows).repartition(4 * files).write.parquet(landing)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(landing)
    index_stream(stream, out, marks, indexing.hashing_embedder(), "hash").awaitTermination()
    return tables.read_embeddings(t.spark, out, "hash").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))


# -- whole jobs -----------------------------------------------------------------------

@check("k1_collect_postings", f"""
WITH a AS ({ALLJOBS_SQL}), {"x AS (SELECT url AS platform_url, 'Job ' || page_id AS title, 'Company ' || (page_id % 7) AS employer_name, CASE page_id % 3 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Bonn' ELSE '' END AS city FROM pages)"},
u AS (SELECT 0 AS o, platform_url, title, employer_name, city, source_platform FROM a
  UNION ALL SELECT 1, platform_url, title, employer_name, city, 'Xing' FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(employer_name), lower(city) ORDER BY o) AS rn FROM u WHERE city <> ''),
f AS (SELECT lower(title) t_, lower(employer_name) e_, lower(city) c_, list_sort(list(DISTINCT source_platform)) AS found_on
  FROM u WHERE city <> '' GROUP BY ALL),
m AS (SELECT platform_url, title, employer_name, city, found_on FROM k JOIN f ON lower(title) = t_ AND lower(employer_name) = e_
    AND lower(city) = c_ WHERE rn = 1
  UNION ALL SELECT platform_url, title, employer_name, city, [source_platform] FROM u WHERE city = '')
SELECT title, city, array_to_string(found_on, ',') AS found_on, {KEY_SQL} AS key FROM m""")
def _(t: Inputs):
    paths = {name: scratch_path(t.spark, name) for name in ("alljobs", "xing", "remotive")}
    _alljobs(t).write.text(paths["alljobs"])
    _xing(t).write.text(paths["xing"])  # the third source has nothing landed and is skipped
    frames, _ = collect.read_sources(t.spark, paths, NOW)
    return collect.collect_postings(frames).select("title", "city", joined("found_on"), "key")


PORTFOLIO_MERGED = f"""
WITH {LISTINGS}, hits AS (SELECT l.*, query_ord FROM l JOIN (VALUES (0, 'ring'), (1, 'red '), (2, 'bolt')) AS f(query_ord, needle)
  ON contains(lower(title || chr(10) || description), needle)),
n AS (SELECT *, trim(regexp_replace(lower(title), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t_, lower(employer_name) AS e_, lower(city) AS c_,
  coalesce(nullif(source_platform, ''), actor) AS src FROM hits),
k AS (SELECT *, row_number() OVER (PARTITION BY query_ord, t_, e_, c_ ORDER BY {ORDER_SQL}) AS rn FROM n WHERE city <> ''),
f AS (SELECT query_ord, t_, e_, c_, list_sort(list(DISTINCT src)) AS found_on FROM n WHERE city <> '' GROUP BY ALL),
m AS (SELECT query_ord, {ORDER_SQL}, title, employer_name, city, found_on FROM k JOIN f USING (query_ord, t_, e_, c_) WHERE rn = 1
  UNION ALL SELECT query_ord, {ORDER_SQL}, title, employer_name, city, [src] FROM n WHERE city = ''),
d AS (SELECT *, row_number() OVER (PARTITION BY employer_name, title, city ORDER BY query_ord, {ORDER_SQL}) AS rn FROM m)
"""


@check("k2_run_portfolio", PORTFOLIO_MERGED + f"""SELECT {IDS_SQL}, title, employer_name, city, array_to_string(found_on, ',') AS found_on FROM d WHERE rn = 1""")
def _(t: Inputs):
    unique, _ = collect.run_portfolio(listings(t), ["ring", None, "red ", " RING", "bolt", "gear"], ORDER, done=["gear"])
    return unique.select(*IDS, "title", "employer_name", "city", joined("found_on"))


@check("k2_summary", PORTFOLIO_MERGED + """SELECT CASE query_ord WHEN 0 THEN 'ring' WHEN 1 THEN 'red' ELSE 'bolt' END AS label,
  count(*) AS rows FROM m GROUP BY query_ord UNION ALL SELECT 'hit total', count(*) FROM m
UNION ALL SELECT 'unique total', count(*) FROM d WHERE rn = 1""")
def _(t: Inputs):
    """Counted while hits and unique jobs are written."""
    queries = ["ring", None, "red ", " RING", "bolt", "gear"]
    return collect.store_portfolio(listings(t), queries, scratch_path(t.spark, "portfolio"), ORDER, done=["gear"])[1]


@check("k3_match", MATCH_SQL)
def _(t: Inputs):
    return match_rows(run_match(t))


@check("k4_prescreen_only", match_sql() + """SELECT profile_id, key, title, n_chars,
  row_number() OVER (PARTITION BY profile_id ORDER BY doc_id) AS position FROM screened""")
def _(t: Inputs):
    return run_match(t, prescreen_only=True, table_order=["doc_id"]).select("profile_id", "key", "title", "n_chars", "position")


@check("f8_table_order", match_sql() + """SELECT profile_id, doc_id,
  row_number() OVER (PARTITION BY profile_id ORDER BY source, n_chars, key) AS position FROM screened""")
def _(t: Inputs):
    return run_match(t, prescreen_only=True, table_order=["employer_name", "n_chars"]).select("profile_id", "doc_id", "position")


@check("k5_resume", MATCH_SQL)
def _(t: Inputs):
    """A run that stopped after the first pass, then one that reuses it."""
    path = scratch_path(t.spark, "verdicts")
    run_match(t, prescreen_only=True, store=RunStore(path, "run-1"))
    return match_rows(run_match(t, store=RunStore(path, "run-2", resume="run-1")))


@check("k5_broken_pass", MATCH_SQL)
def _(t: Inputs):
    """A run whose model dies in the midst of the second pass, then the same run
    again: verdicts that were stored are not asked for a second time."""
    path, spark = scratch_path(t.spark, "verdicts"), t.spark
    store, rated = RunStore(path, "run-1", bucket_rows=600), spark.sparkContext.accumulator(0)

    def dying(messages: list[str]) -> list[str]:
        if any(_parts(m)[0] % 97 == 5 for m in messages):
            raise ModelStopped("quota used up")
        return recruiter_model(messages)

    def counted(messages: list[str]) -> list[str]:
        rated.add(len(messages))
        return ["{}" if _parts(m)[0] % 37 == 1 else recruiter_model([m])[0] for m in messages]

    try:
        run_match(t, store=store, models=Models(prescreen_model, dying, candidate_model))
    except PythonException:
        pass
    before = tables.read_verdicts(spark, path, "run-1", usable=True).where("pass = 'recruiter'").count()
    out = settle(match_rows(run_match(t, store=store, models=Models(_broken, counted, candidate_model))))
    after = tables.read_verdicts(spark, path, "run-1").where("pass = 'recruiter'").count()
    if rated.value != after - before:
        raise AssertionError(f"{rated.value} messages for {after - before} missing verdicts")
    return out


def _broken(messages: list[str]) -> list[str]:
    """Only what failed may come again."""
    if any(_parts(m)[0] % 37 for m in messages):
        raise ModelStopped("a stored verdict was asked for again")
    raise TimeoutError("still no answer")


@check("i4_progress", f"""
WITH {DOCS} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE doc_id % 37 = 0) AS BIGINT) AS failed,
  CAST(ceil(count(*) / 150.0) AS INTEGER) AS buckets FROM p""")
def _(t: Inputs):
    """What the notes of a stored pass add up to."""
    store = RunStore(scratch_path(t.spark, "verdicts"), "run", bucket_rows=150)
    stored_pass(_rows(t), prescreen_model, PRESCREEN, store, concurrency=8)
    notes = tables.read_progress(t.spark, store.path, "run").where("bucket >= 0")
    return notes.agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"), F.max("buckets").alias("buckets"))


@check("k7_rescore", match_sql() + f""",
again AS (SELECT profile_id, key, {recruiter_sql(SCREEN_WEIGHTS)} AS rec_sc, candidate_score AS cand_sc FROM final)
SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rec_sc DESC, cand_sc DESC, key) AS place FROM again WHERE rec_sc >= 65""")
def _(t: Inputs):
    again = rescore(run_match(t).drop("rank"), SCREEN_WEIGHTS, CANDIDATE_WEIGHTS, threshold=65)
    placed = rank_within(again, ["profile_id"], [*rescored_order(), F.asc("key")], "place")
    return placed.select("profile_id", "key", F.col("recruiter_score").alias("rec_sc"),
                         F.col("candidate_score").alias("cand_sc"), "place")


@check("k7_rescored_table", f"""
WITH {VERDICTS}, x AS (SELECT *, {recruiter_sql(SCREEN_WEIGHTS)} AS rec_sc, {candidate_sql(CANDIDATE_WEIGHTS)} AS cand_sc FROM r)
SELECT 'Posting ' || doc_id AS title, source AS employer_name, lang AS city, rec_sc, cand_sc, d.text AS description,
  'ok' AS recruiter_notes FROM x JOIN (SELECT doc_id, text FROM documents) d USING (doc_id) WHERE rec_sc >= 30""")
def _(t: Inputs):
    return rescored_preview(match_table(t), SCREEN_WEIGHTS, CANDIDATE_WEIGHTS, 30)


@check("k7_table_order", f"""
WITH {VERDICTS}, x AS (SELECT *, {recruiter_sql(SCREEN_WEIGHTS)} AS rec_sc, {candidate_sql(CANDIDATE_WEIGHTS)} AS cand_sc FROM r),
o AS (SELECT rec_sc, cand_sc, row_number() OVER (ORDER BY rec_sc DESC, cand_sc DESC) AS position FROM x WHERE rec_sc >= 30)
SELECT rec_sc, cand_sc, min(position) AS first, max(position) AS last FROM o GROUP BY 1, 2""")
def _(t: Inputs):
    """The places that rows of equal scores take in the sorted table."""
    shown_table = rescored_preview(match_table(t), SCREEN_WEIGHTS, CANDIDATE_WEIGHTS, 30)
    placed = global_rank(shown_table.select("rec_sc", "cand_sc").withColumn("at", F.monotonically_increasing_id()), [F.asc("at")], rank="position")
    return placed.groupBy("rec_sc", "cand_sc").agg(F.min("position").alias("first"), F.max("position").alias("last"))


@check("k8_recent_match", match_sql(where="posted_at >= DATE '2026-05-20' - 28") + """
SELECT profile_id, key, recruiter_score, candidate_score FROM final""")
def _(t: Inputs):
    return run_match(t, posted_since="4 weeks ago").select("profile_id", "key", "recruiter_score", "candidate_score")


@check("h34_replace_themes", f"""
WITH {LABEL_QUERIES} SELECT query_id AS profile_id, 'x' || label || ',y' AS role_themes, '' AS must_have_themes FROM q""")
def _(t: Inputs):
    p = profiles(t)
    edited = p.select("profile_id", F.array(F.concat(F.lit(" x"), F.substring("profile_id", 2, 9)), F.lit(" "), F.lit("y")).alias("role_themes"),
                      *[F.array(F.lit("")).alias(n) for n in THEME_LISTS[1:]])
    return tables.replace_themes(p, edited).select("profile_id", joined("role_themes"), joined("must_have_themes"))
