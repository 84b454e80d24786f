"""A corpus pipeline of five stages over the table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, further ones included, whatever their names.
An empty table passes through every stage. ``run`` writes each stage's result to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanboard.llm import jaccard_join, language_id, mixing, packing, substring_dedup
from gleanboard.llm.queries import word_bpe
from gleanboard.session import scratch_path

#: A document whose best language has a smaller share is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without one (null or no letters), or of no dominant one, go.

    Every row is judged by its text alone, so rows that repeat and null ids are treated like any other.
    """
    model = language_id.learn(docs)
    judged = language_id.predict(docs, model, keep=tuple(docs.columns), into=("_lang", "_share", "_set", "_shares"))
    kept = judged.where((F.col("_lang") != language_id.UNKNOWN) & (F.col("_share") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("_lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that share 80 % of their 5-word shingles, one stays: the smallest id.

    Null ids come last, of equal ids the smallest hash of the text stays; a row that
    repeats stays once; documents without words are no copies of each other.
    """
    return jaccard_join.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that windows of 50 repeat from a document of smaller id; a document left without words goes.

    Rows that share an id are not held against each other; a row with a null id is neither cut nor a reason to cut.
    """
    cut = substring_dedup.remove_repeats(docs).where("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_tag"])
    tagged = docs.withColumn("_own", F.xxhash64("text"))
    joined = tagged.join(cut, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_tag")), "left")
    text = F.coalesce("_kept", "text")
    return joined.where(F.coalesce(F.col("_kept") != "", F.lit(True))).select(
        *(text.alias("text") if c == "text" else F.when(F.col("_kept").isNotNull(), F.char_length("_kept").cast("long")).otherwise(
            F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks; rows that repeat share the copies of all of them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is one end token."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixture", mixture),
    ("packed", packed),
]

#: The stages learn, tilt and pack; SQL cannot express them. Tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
