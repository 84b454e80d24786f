"""The registered queries: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bit_sliced,
    chat_format,
    collocations,
    embedding_dedup,
    html_extraction,
    importance,
    jaccard_join,
    language_id,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    substring_dedup,
)
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = d.doc_id""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents, _ = jaccard_join.jaccard_groups(table(spark, folder, "documents"))
    return documents.select("doc_id", "n_shingles", "component_id")


@query("op2_html_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def word_bpe() -> str:
    """The given vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), word_bpe())


@query("op5_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS owner FROM g GROUP BY h),
f AS (SELECT DISTINCT doc_id, i FROM g JOIN m USING (h) WHERE doc_id > owner),
v AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (SELECT doc_id, i, x, max(f.i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM v LEFT JOIN f USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sample = quality_rules.with_stats(quality_rules.labelled(docs, table(spark, folder, "labels")))
    rules = quality_rules.learn(sample, among=~quality_rules.base_failed())
    judged = quality_rules.with_stats(docs).withColumn("base_failed", quality_rules.base_failed())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & rules.keeps()).alias("kept"), rules.fired().alias("rule"))


@query("op7_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = e.vec_id""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~held_out()))
    return language_id.predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_chat_format", """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
          + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 23 AS written FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(written)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), control)
    turns = rows.union(more).withColumn("parts", chat_format.text_part(F.col("text")))
    back = chat_format.read_back(chat_format.format_chat(turns))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out())
    # Grades: 0 toxic, 1 low quality, 2 good.
    ratings = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade"))
    model = quality_classifier.learn(docs, ratings)
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))


@query("op11_bit_sliced", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v ON len(q.e) = len(v.e) AND v.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op12_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, g, a, j, array_to_string(w[1:j], ' ') AS h, array_to_string(w[j + 1:], ' ') AS t
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT x.lang, x.g, x.a, x.j, h.f AS l, t.f AS r, n.n,
             CAST((1000::HUGEINT * x.a * n.n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
      FROM x JOIN f h ON h.lang = x.lang AND h.g = x.h JOIN f t ON t.lang = x.lang AND t.g = x.t JOIN n ON n.lang = x.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
i AS (SELECT c.lang, array_to_string(c.w[i:i + z - 1], ' ') AS g, max(c.a) AS around
      FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c) c, (SELECT unnest(range(2, 5)) AS z) WHERE z < c.k AND i + z - 1 <= c.k GROUP BY ALL),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.g) AS rank
      FROM m LEFT JOIN i ON i.lang = m.lang AND i.g = m.g WHERE i.around IS NULL OR 100 * i.around < 100 * m.a)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM o WHERE rank <= 2000""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_importance", r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
                  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS k),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT unnest(w) AS w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
h AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))),
             lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))),
             lambda c, y: xor(k[xor(c, y) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket FROM v, k),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
s AS (SELECT bucket, count(*) AS s FROM e JOIN h USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS w FROM b) JOIN h USING (w) GROUP BY 1),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s, coalesce((SELECT sum(t) FROM t), 0) AS t),
g AS (SELECT r.bucket, CAST(floor(1000 * ln(((coalesce(t.t, 0)::DOUBLE + 1) * (a.s::DOUBLE + 10000))
             / ((coalesce(s.s, 0)::DOUBLE + 1) * (a.t::DOUBLE + 10000)))) AS BIGINT) AS gain
      FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
m AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM e JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
             (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM o)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM o WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM p""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
