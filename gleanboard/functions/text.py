"""Text cleaning, names, labels and the texts shown to models."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Unicode white space, plus the four ASCII separators Python also counts.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
TAG = r"<[^>]+>"

# Entities decoded without leaving the JVM, in the order they are applied.
PLAIN_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                  ("&nbsp;", " "), ("&amp;", "&")]
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|amp);)[#A-Za-z]"


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, SPACE, " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], cols[-1])


def shown(c: Column) -> Column:
    """Text of a value where a missing one prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


@F.pandas_udf(StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """Decode HTML entities.

    The frequent ones are replaced by built-in functions. Only texts that hold
    another entity travel to the Python worker; the rest are sent as null.
    """
    plain = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), PLAIN_ENTITIES, c)
    return F.coalesce(_unescape_all(F.when(c.rlike(OTHER_ENTITY), c)), plain)


def decode_plain_entities(c: Column) -> Column:
    """JVM-only variant for text known to hold no other entities."""
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), PLAIN_ENTITIES, c)


def strip_html(c: Column, all_entities: bool = True) -> Column:
    """Tags to spaces, then entities, then white space; null gives ''.

    The order matters: an escaped tag such as ``&lt;b&gt;`` stays as text.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " ")
    decoded = decode_entities(bare) if all_entities else decode_plain_entities(bare)
    return F.trim(squeeze(decoded))


def strip_html_if_tagged(c: Column, all_entities: bool = True) -> Column:
    """Strip only where a ``<`` occurs; other text keeps its entities."""
    tagged = F.contains(c, F.lit("<"))
    return F.when(tagged, strip_html(F.when(tagged, c), all_entities)).otherwise(c)


def match_text(c: Column) -> Column:
    """Form under which two sources name the same thing; null stays null.

    Printable ASCII, which is nearly all, knows one kind of white space and needs no Unicode classes."""
    plain = F.trim(F.regexp_replace(F.lower(c), "  +", " "))
    return F.when(c.rlike("[^ -~]"), F.trim(squeeze(F.lower(c)))).otherwise(plain)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(c, "[^a-zA-Z0-9]+", "-")
    return first_filled(F.lower(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit("x"))


def file_safe(c: Column, length: int = 60) -> Column:
    joined = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^A-Za-z0-9._-]+", "_")
    return first_filled(F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, length), F.lit("untitled"))


def file_slug(employer: Column, title: Column) -> Column:
    return F.concat_ws("_", file_safe(employer), file_safe(title))


def query_label(c: Column) -> Column:
    lowered = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    return first_filled(F.regexp_replace(lowered, SPACE, "_"), F.lit("query"))


def form_text(c: Column) -> Column:
    """A form field as stripped text; null gives ''."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def form_int(c: Column, default: int | None) -> Column:
    """A form field as an integer; blank or not a number gives the default."""
    return F.coalesce(form_text(c).try_cast("int"), F.lit(default).cast("int"))


def retrieval_text(title: Column, employer: Column, city: Column, description: Column) -> Column:
    """The non-blank fields that carry retrieval signal, one per line."""
    return F.concat_ws("\n", *[blank_to_null(c) for c in (title, employer, city, description)])


def posting_text(max_description: int | None = None) -> Column:
    """The posting as shown to a scoring pass (whole description by default)."""
    description = F.col("description")
    if max_description is not None:
        description = F.substring(description, 1, max_description)
    return F.concat(
        F.lit("Title: "), shown(F.col("title")),
        F.lit("\nCompany: "), shown(F.col("employer_name")),
        F.lit("\nLocation: "), shown(F.col("city")), F.lit(", "), shown(F.col("country")),
        F.lit("\nDescription: "), shown(description),
    )


def answer_text(max_description: int | None = None) -> Column:
    """The posting as shown to question answering (whole description by default)."""
    description = shown(F.col("description"))
    if max_description is not None:
        description = F.substring(description, 1, max_description)
    return F.concat(
        F.lit("Title: "), shown(F.col("title")),
        F.lit("\nCompany: "), shown(F.col("employer_name")),
        F.lit("\nLocation: "), shown(F.col("city")), F.lit(", "), shown(F.col("country")),
        F.lit("\nPosted: "), shown(F.date_format("posted_at", "yy/MM/dd")),
        F.lit("\nDescription: "), description,
    )


def cv_message(cv_text: Column, posting: Column, now: dt.datetime) -> Column:
    # Wording of the message both CV passes send.
    head = "Your knowledge cutoff date is outdated, the current month is actually "
    return F.concat(
        F.lit(f"{head}{now:%B %Y}.\n\nCANDIDATE CV:\n"), shown(cv_text),
        F.lit("\n\nJOB POSTING:\n"), posting,
    )


def profile_message(profile: Column, posting: Column) -> Column:
    return F.concat(F.lit("CANDIDATE PROFILE:\n"), F.to_json(profile),
                    F.lit("\n\nJOB POSTING:\n"), posting)
