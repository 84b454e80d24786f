"""Chat formatting with typed content parts, in column expressions only.

A turn holds a text or a list of typed parts. A visitor writes every part in
order: texts escaped, images, audio and documents as placeholders whose
references and expanded token counts are recorded beside the output.

Template of one turn: ``<|turn|>role<|text|>body<|end|>``. Every mark begins
with ``<``, and roles and texts are escaped so that they hold no ``<`` and no
``[``: a text can neither close a turn nor spell a control string of another
template, and ``unescape`` gives it back unchanged.

Defined results: a null role, text or part counts as empty; an unknown part
type is an attachment of that type with no tokens; a null conversation id is
one conversation; rows of equal turn are ordered by role, then body, and
repeated rows are all kept; an empty table gives an empty result. Columns
other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
#: Tokens for one unit of a part's ``amount``: tiles of an image, seconds of audio, pages of a document.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}
PART = "struct<type:string,text:string,uri:string,amount:double>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A list with one text part, for turns that are plain texts."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"),
        F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("amount")))


def _visit(part: Column, place: Column) -> Column:
    """What a part writes."""
    kind = F.coalesce(part["type"], F.lit("text"))
    mark = F.concat(F.lit("<|"), escape(kind), F.lit(":"), place.cast("string"), F.lit("|>"))
    return F.when(kind == "text", F.coalesce(escape(part["text"]), F.lit(""))).otherwise(mark)


def _attachment(part: Column, place: Column, tokens: dict[str, float]) -> Column:
    rate = F.lit(0.0)
    for kind, per_unit in tokens.items():
        rate = F.when(part["type"] == kind, F.lit(per_unit)).otherwise(rate)
    return F.struct(
        part["type"].alias("type"), part["uri"].alias("uri"), place.cast("int").alias("place"),
        F.ceil(rate * F.coalesce(part["amount"], F.lit(1.0))).cast("long").alias("tokens"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learned: str = LEARNED_ROLE,
                tokens: dict[str, float] | None = None) -> DataFrame:
    """One row per conversation: (conv, formatted, loss, attachments, attachment_tokens).

    ``parts`` is an array of PART. ``loss`` lists the spans that a model learns:
    (turn_at, offset, length, start), in code points; ``offset`` counts inside
    the turn, ``start`` in the whole text. A running sum places the turns, so
    the work is linear in the length of a conversation.
    """
    rates = TOKENS_PER_UNIT if tokens is None else tokens
    who = F.coalesce(F.col(role), F.lit(""))
    items = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    written = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), escape(who).alias("who"), (who == learned).alias("learn"),
        F.array_join(F.transform(items, _visit), "").alias("body"),
        F.transform(F.filter(F.transform(items, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                             lambda x: F.coalesce(x["p"]["type"], F.lit("text")) != "text"),
                    lambda x: _attachment(x["p"], x["i"], rates)).alias("attachments"))
    written = written.withColumn("piece", F.concat(F.lit(TURN), "who", F.lit(TEXT), "body", F.lit(END)))
    order = W.partitionBy("conv").orderBy("turn", "who", "body")
    placed = written.select(
        "conv", "piece", "attachments", "learn", F.char_length("body").cast("long").alias("length"),
        (F.row_number().over(order) - 1).alias("turn_at"),
        (F.char_length("who") + len(TURN) + len(TEXT)).cast("long").alias("offset"),
        (F.sum(F.char_length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0))
         - F.char_length("piece")).alias("before"))
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("turn_at", "offset", "length", "before", "learn", "piece", "attachments"))).alias("t"))
    return whole.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(
            x["turn_at"].alias("turn_at"), x["offset"].alias("offset"), x["length"].alias("length"),
            (x["before"] + x["offset"]).alias("start"))).alias("loss"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attachments"], lambda a: F.struct(
            x["turn_at"].alias("turn_at"), a["place"].alias("place"), a["type"].alias("type"),
            a["uri"].alias("uri"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.aggregate(
            x["attachments"], F.lit(0).cast("long"), lambda m, a: m + a["tokens"])).alias("attachment_tokens"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, loss_text, formatted_chars) read from the output alone.

    ``turns`` lists (role, text) in order, ``loss_text`` joins all text under
    the loss mask. Placeholders stay as they are written.
    """
    pieces = formatted.select(
        conv, "loss", F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2**31 - 1).alias("pieces"))
    return pieces.select(
        conv,
        F.transform("pieces", lambda p: F.struct(
            unescape(F.split(p, r"<\|text\|>")[0]).alias("role"),
            unescape(F.split(F.split(p, r"<\|text\|>")[1], r"<\|end\|>")[0]).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(
            F.get(F.col("pieces"), s["turn_at"]), (s["offset"] - len(TURN) + 1).cast("int"), s["length"].cast("int")))),
            "").alias("loss_text"),
        "formatted_chars")
