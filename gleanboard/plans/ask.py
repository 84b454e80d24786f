"""Question answering over the best postings, for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import answer_text
from ..operators.dedupe import require_unique_key
from ..operators.filters import metadata_filter
from ..operators.joins import postings_of, rows_of_hits
from ..operators.nearest import search
from ..operators.passes import Model, ask_model
from ..session import settle

# Separators of the context and the question.
BETWEEN = "\n\n---\n\n"
TOP_K = 50


def contexts(hits: DataFrame, postings: DataFrame, max_description: int | None = None) -> DataFrame:
    """(query_id, context): the formatted postings of a question in rank order.

    A group holds at most k texts, whole unless ``max_description`` is given.
    """
    texts = rows_of_hits(hits, postings).select("query_id", "rank", answer_text(max_description).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return texts.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), BETWEEN).alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, postings: DataFrame,
            max_description: int | None = None) -> DataFrame:
    """(query_id, prompt) of every question, also of one without a hit."""
    found = contexts(hits, postings, max_description)
    return questions.join(found, "query_id", "left").select("query_id", F.concat(
        F.lit("Context:\n\n"), F.coalesce("context", F.lit("")),
        F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def ask(
    questions: DataFrame, postings: DataFrame, index: DataFrame, model: Model, *,
    k: int = TOP_K, city: str | None = None, country: str | None = None,
    concurrency: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, sources) for questions with query_id, question and embedding.

    The place filter and the scope are applied before scoring. Sources carry
    rank and score.
    """
    questions = settle(questions)  # a model may have made their vectors
    allowed = metadata_filter(postings, city=city, country=country)
    hits = settle(search(index, questions.select("query_id", "embedding"), k, scope=allowed))
    found = require_unique_key(settle(postings_of(hits, allowed)))
    texts = prompts(questions, hits, found).withColumnRenamed("prompt", "message")
    answers = settle(ask_model(texts, model, ["query_id"], concurrency=concurrency).select(
        "query_id", F.col("reply").alias("answer"), F.col("call_error").alias("error")))
    return answers, rows_of_hits(hits, found)
