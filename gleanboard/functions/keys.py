"""Hash keys, metadata and rendering of list columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import match_text

FILTERABLE = ["platform", "city", "country", "employer_name", "key"]


def posting_key() -> Column:
    """First 32 hex digits of the SHA-1 over sources, url, title and employer.

    A missing url or title enters the hash as the text ``None``, a missing
    employer as the empty string. The key changes when a job is found on one
    more source; use ``match_key`` for incremental work.
    """
    return F.substring(
        F.sha1(F.concat_ws(
            "|",
            F.coalesce(F.array_join("found_on", " "), F.lit("")),
            F.coalesce("platform_url", F.lit("None")),
            F.coalesce("title", F.lit("None")),
            F.coalesce("employer_name", F.lit("")),
        )), 1, 32)


def match_key() -> Column:
    """SHA-1 of the normalised employer, title and city; same on every run."""
    parts = [F.coalesce(match_text(F.col(c)), F.lit("")) for c in ("employer_name", "title", "city")]
    # Each part with its length, so that no two triples are written alike.
    return F.substring(F.sha1(F.concat_ws("|", *[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts])), 1, 32)


def metadata(columns: list[str], filterable: list[str] = FILTERABLE) -> Column:
    """Filterable columns that exist and are not null, as a string map."""
    names = [c for c in filterable if c in columns]
    if "key" not in names:
        names.append("key")
    pairs = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def render_list(c: Column) -> Column:
    """A list as ', '-joined text; null gives ''."""
    return F.coalesce(F.array_join(c, ", "), F.lit(""))
