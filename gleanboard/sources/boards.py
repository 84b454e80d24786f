"""Field maps of the job boards: landed JSON lines in, unified postings out.

A board is an explicit schema plus column expressions. ``raw`` keeps the line
as it was; everything else is typed, so an empty landing folder gives an empty
table of the right shape.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import epoch_date, parse_posted_at
from ..functions.places import (after_last_comma, alias_table, before_first_comma, first_of, joined_field,
                                joined_or_null, with_location)
from ..functions.text import first_filled, strip_html, strip_html_if_tagged
from ..operators.filters import is_remote, without_sentinel
from ..schemas import POSTING, conform


@dataclass(frozen=True)
class Board:
    name: str
    item: str                                   # DDL of one landed item
    fields: Callable[[dt.datetime], dict[str, Column]]
    platform: str | None = None                 # constant board name
    location: str | None = None                 # free text to split
    keep: Callable[[DataFrame], DataFrame] | None = None


def _filled(*cols: str) -> Column:
    return first_filled(*[F.col(c) for c in cols], F.lit(""))


def _either(*cols: str) -> Column:
    return first_filled(*[F.col(c) for c in cols])


def _text_or_html(text: str, html: str) -> Column:
    missing = F.coalesce(F.col(text), F.lit("")) == ""
    return F.when(missing, strip_html(F.when(missing, F.col(html)))).otherwise(F.col(text))


ALLJOBS = Board(
    "alljobs",
    "platform_url string, official_url string, title string, company_name string, job_type string, "
    "description string, platform string, review_count bigint, company_rating double, "
    "posted_date string, location string",
    lambda now: {
        "platform_url": F.col("platform_url"),
        "job_url": _either("official_url", "platform_url"),
        "title": F.col("title"),
        "employer_name": F.col("company_name"),
        "employer_ratings_count": F.col("review_count"),
        "employer_rating": F.col("company_rating"),
        "posted_at": parse_posted_at(F.col("posted_date"), now),
        "employment_type": F.col("job_type"),
        "description": strip_html_if_tagged(F.col("description")),
        "source_platform": F.col("platform"),
    },
    location="location",
)

XING = Board(
    "xing",
    "url string, apply_url string, title string, company string, location string, company_city string, "
    "location_country string, location_country_code string, date_posted string, job_type string, "
    "employment_type_id string, description_text string, description_html string",
    lambda now: {
        "platform_url": F.col("url"),
        "job_url": _either("apply_url", "url"),
        "title": F.col("title"),
        "employer_name": F.col("company"),
        "country": _filled("location_country", "location_country_code"),
        "city": _filled("location", "company_city"),
        "posted_at": parse_posted_at(F.col("date_posted"), now),
        "employment_type": _either("job_type", "employment_type_id"),
        "description": _text_or_html("description_text", "description_html"),
    },
    platform="Xing",
)

INDEED = Board(
    "indeed",
    "key string, url string, jobUrl string, title string, dateOnIndeed string, "
    "employer struct<name:string,ratingsCount:bigint,ratingsValue:double>, "
    "location struct<countryName:string,city:string>, jobTypes struct<CF3CP:string>, "
    "description struct<text:string,html:string>",
    lambda now: {
        "platform_url": F.col("url"),
        "job_url": F.col("jobUrl"),
        "title": F.col("title"),
        "employer_name": F.col("employer.name"),
        "employer_ratings_count": F.col("employer.ratingsCount"),
        "employer_rating": F.col("employer.ratingsValue"),
        "country": _filled("location.countryName"),
        "city": _filled("location.city"),
        "posted_at": parse_posted_at(F.col("dateOnIndeed"), now),
        "employment_type": F.col("jobTypes.CF3CP"),
        "description": _text_or_html("description.text", "description.html"),
    },
    platform="Indeed",
)

LINKEDIN = Board(
    "linkedin",
    "id string, link string, applyUrl string, title string, companyName string, location string, "
    "postedAt string, employmentType string, descriptionText string, descriptionHtml string",
    lambda now: {
        "platform_url": F.col("link"),
        "job_url": _either("applyUrl", "link"),
        "title": F.col("title"),
        "employer_name": F.col("companyName"),
        "posted_at": parse_posted_at(F.col("postedAt"), now),
        "employment_type": F.col("employmentType"),
        "description": _text_or_html("descriptionText", "descriptionHtml"),
    },
    platform="LinkedIn",
    location="location",
)

ARBEITNOW = Board(
    "arbeitnow",
    "slug string, url string, title string, company_name string, location string, description string, "
    "created_at bigint, remote boolean, tags array<string>, job_types array<string>",
    lambda now: {
        "platform_url": F.col("url"),
        "job_url": F.col("url"),
        "title": F.col("title"),
        "employer_name": F.col("company_name"),
        "country": F.lit(""),
        "city": _filled("location"),
        "posted_at": epoch_date(F.col("created_at")),
        "employment_type": joined_or_null(F.col("job_types")),
        "description": strip_html(F.col("description")),
    },
    platform="Arbeitnow",
    keep=lambda df: df.where(is_remote(F.col("remote"), F.col("tags"))),
)

HIMALAYAS = Board(
    "himalayas",
    "guid string, applicationLink string, title string, companyName string, description string, "
    "employmentType string, pubDate bigint, "
    "locationRestrictions array<struct<alpha2:string,name:string,slug:string>>",
    lambda now: {
        "platform_url": F.col("applicationLink"),
        "job_url": F.col("applicationLink"),
        "title": F.col("title"),
        "employer_name": F.col("companyName"),
        "country": joined_field(F.col("locationRestrictions"), "name"),
        "city": F.lit(""),
        "posted_at": epoch_date(F.col("pubDate")),
        "employment_type": F.col("employmentType"),
        "description": F.coalesce(strip_html_if_tagged(F.col("description")), F.lit("")),
    },
    platform="Himalayas",
)

REMOTIVE = Board(
    "remotive",
    "id bigint, url string, title string, company_name string, candidate_required_location string, "
    "publication_date string, job_type string, description string",
    lambda now: {
        "platform_url": F.col("url"),
        "job_url": F.col("url"),
        "title": F.col("title"),
        "employer_name": F.col("company_name"),
        "country": _filled("candidate_required_location"),
        "city": F.lit(""),
        "posted_at": parse_posted_at(F.col("publication_date"), now),
        "employment_type": F.col("job_type"),
        "description": strip_html(F.col("description")),
    },
    platform="Remotive",
)

WEWORKREMOTELY = Board(
    "weworkremotely",
    "id string, url string, applyUrl string, title string, company string, companyHq string, "
    "postedAt string, employmentType string, employmentTypeNormalized string, descriptionText string, "
    "descriptionHtml string, type string, applicantCountries string",
    lambda now: {
        "platform_url": F.col("url"),
        "job_url": _either("applyUrl", "url"),
        "title": F.col("title"),
        "employer_name": F.col("company"),
        "country": first_filled(first_of(F.col("applicantCountries")),
                                F.coalesce(after_last_comma(F.col("companyHq")), F.lit(""))),
        "city": before_first_comma(F.col("companyHq")),
        "posted_at": parse_posted_at(F.col("postedAt"), now),
        "employment_type": _either("employmentTypeNormalized", "employmentType"),
        "description": _text_or_html("descriptionText", "descriptionHtml"),
    },
    platform="We Work Remotely",
    keep=without_sentinel,
)

BOARDS = {b.name: b for b in (ALLJOBS, XING, INDEED, LINKEDIN, ARBEITNOW, HIMALAYAS, REMOTIVE, WEWORKREMOTELY)}


def board(name: str) -> Board:
    if name not in BOARDS:
        raise ValueError(f"unknown source: {name!r}; known: {', '.join(BOARDS)}")
    return BOARDS[name]


def normalise(lines: DataFrame, name: str, now: dt.datetime) -> DataFrame:
    """Unified postings of landed JSON lines (column ``value``), batch or stream."""
    b = board(name)
    items = (lines.where(F.trim("value") != "")
             .select("*", F.from_json("value", b.item).alias("_item"))
             .select("_item.*", F.col("value").alias("raw"),
                     *[c for c in lines.columns if c != "value"]))
    if b.keep is not None:
        items = b.keep(items)
    extra = tuple(c for c in lines.columns if c != "value")
    # Built before anything is overwritten, so no field reads another's result.
    fields = dict(b.fields(now))
    if b.platform is not None:
        fields["source_platform"] = F.lit(b.platform)
    carried = [F.col("raw"), *[F.col(c) for c in extra]]
    if b.location is not None:
        carried.append(F.col(b.location).alias("_location"))
    out = items.select(*[c.alias(n) for n, c in fields.items()], *carried)
    if b.location is not None:
        out = with_location(out, "_location", "city", "country", alias_table(lines.sparkSession))
    return conform(out, POSTING, keep=extra)


def read_board(spark: SparkSession, name: str, path: str, now: dt.datetime) -> DataFrame:
    """Landed files of one board with ``row_ord`` for first-wins rules.

    The order is that of file names and of lines in a file, however Spark cuts
    and packs the files: the id only orders the lines of one block.
    """
    board(name)
    return normalise(numbered(located_lines(spark.read.text(path))), name, now)


def located_lines(lines: DataFrame) -> DataFrame:
    """Landed lines with the file and block they come from, batch or stream."""
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered(lines: DataFrame) -> DataFrame:
    """``row_ord`` of located lines that no shuffle has moved; of a stream, within a micro-batch."""
    return lines.select("value", F.concat_ws(
        " ", "_file", F.lpad(F.col("_block").cast("string"), 20, "0"),
        F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("row_ord"))
