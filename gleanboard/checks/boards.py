"""Checks of the board field maps: items are built from the pages table, landed
as JSON lines, and read back as unified postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from ..sources.boards import normalise, read_board
from .expressions import html_text_sql
from .inputs import NOW
from .registry import Inputs, check

PLAIN = html_text_sql("html")
POSTED_SQL = """CASE page_id % 4 WHEN 0 THEN '2026-05-17' WHEN 1 THEN '2026-05-10'
  WHEN 2 THEN strftime(DATE '2025-05-11' + CAST(page_id AS INTEGER), '%Y-%m-%d') ELSE '' END"""
EPOCH_SQL = "strftime(DATE '2025-05-11' + CAST(page_id AS INTEGER), '%Y-%m-%d')"
CITY_SQL = "CASE page_id % 5 WHEN 0 THEN 'Berlin' WHEN 2 THEN 'Hamburg' ELSE '' END"
COUNTRY_SQL = "CASE page_id % 5 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Germany' ELSE '' END"


def number() -> Column:
    return F.col("page_id")


def epoch() -> Column:
    return F.lit(1_747_000_000) + number() * 86_400


def posted() -> Column:
    return (F.when(number() % 4 == 0, "3 days ago").when(number() % 4 == 1, "2026-05-10T14:23:00Z")
            .when(number() % 4 == 2, epoch().cast("string")).otherwise("some day"))


def company() -> Column:
    return F.concat(F.lit("Company "), (number() % 7).cast("string"))


def title() -> Column:
    return F.concat(F.lit("Job "), number().cast("string"))


def location() -> Column:
    return (F.when(number() % 5 == 0, "Berlin, BE, Deutschland").when(number() % 5 == 1, "Germany")
            .when(number() % 5 == 2, "Hamburg").when(number() % 5 == 3, " , ,"))


def landed(t: Inputs, **fields: Column) -> DataFrame:
    """JSON lines of items; null fields are absent, as boards send them."""
    return t.pages.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


def shown(df: DataFrame) -> DataFrame:
    """All posting columns without nulls, rendered for comparison."""
    texts = ["platform_url", "job_url", "title", "employer_name", "country", "city", "employment_type",
             "description", "source_platform"]
    return df.select(
        *[F.coalesce(c, F.lit("-")).alias(c) for c in texts],
        F.coalesce("employer_ratings_count", F.lit(-1)).alias("ratings"),
        F.coalesce("employer_rating", F.lit(-1.0)).alias("rating"),
        F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("")).alias("posted"),
        F.col("raw").isNotNull().alias("has_raw"))


def expected(platform: str, *, job_url="url", country="''", city="''", kind="'-'", description=PLAIN,
             ratings="-1", rating="-1.0", posted=POSTED_SQL, where="TRUE") -> str:
    return f"""SELECT url AS platform_url, {job_url} AS job_url, 'Job ' || page_id AS title,
  'Company ' || (page_id % 7) AS employer_name, {country} AS country, {city} AS city, {kind} AS employment_type,
  {description} AS description, {platform} AS source_platform, CAST({ratings} AS BIGINT) AS ratings,
  CAST({rating} AS DOUBLE) AS rating, {posted} AS posted, TRUE AS has_raw FROM pages WHERE {where}"""


def _alljobs(t: Inputs) -> DataFrame:
    return landed(
        t, platform_url=F.col("url"), official_url=F.when(number() % 3 == 0, F.concat("url", F.lit("/apply"))).when(number() % 3 == 1, ""),
        title=title(), company_name=company(), review_count=number(), company_rating=(number() % 5).cast("double") / 2,
        posted_date=posted(), job_type=F.lit("fulltime"),
        description=F.when(number() % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("R&amp;D at "), "url")),
        platform=F.when(number() % 2 == 0, "LinkedIn").otherwise("Glassdoor"), location=location())


ALLJOBS_SQL = expected(
    "CASE WHEN page_id % 2 = 0 THEN 'LinkedIn' ELSE 'Glassdoor' END",
    job_url="CASE WHEN page_id % 3 = 0 THEN url || '/apply' ELSE url END", country=COUNTRY_SQL, city=CITY_SQL,
    kind="'fulltime'", ratings="page_id", rating="(page_id % 5) / 2.0",
    description=f"CASE WHEN page_id % 2 = 0 THEN {PLAIN} ELSE 'R&amp;D at ' || url END")


@check("a1_landing_reader", ALLJOBS_SQL)
def _(t: Inputs):
    path = scratch_path(t.spark, "landing")
    _alljobs(t).write.text(path)
    return shown(read_board(t.spark, "alljobs", path, NOW))


@check("a2_alljobs", ALLJOBS_SQL)
def _(t: Inputs):
    return shown(normalise(_alljobs(t), "alljobs", NOW))


def _xing(t: Inputs) -> DataFrame:
    return landed(
        t, url=F.col("url"), apply_url=F.when(number() % 2 == 0, F.concat("url", F.lit("/apply"))), title=title(), company=company(),
        location=F.when(number() % 3 == 0, "Berlin").otherwise(""), company_city=F.when(number() % 3 == 1, "Bonn"),
        location_country=F.when(number() % 2 == 0, "Deutschland"), location_country_code=F.lit("DE"), date_posted=posted(),
        job_type=F.when(number() % 4 == 0, "FULL_TIME"), employment_type_id=F.lit("7"),
        description_text=F.when(number() % 2 == 0, "plain  text"), description_html=F.col("html"))


XING_SQL = expected(
    "'Xing'", job_url="CASE WHEN page_id % 2 = 0 THEN url || '/apply' ELSE url END",
    country="CASE WHEN page_id % 2 = 0 THEN 'Deutschland' ELSE 'DE' END",
    city="CASE page_id % 3 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Bonn' ELSE '' END",
    kind="CASE WHEN page_id % 4 = 0 THEN 'FULL_TIME' ELSE '7' END",
    description=f"CASE WHEN page_id % 2 = 0 THEN 'plain  text' ELSE {PLAIN} END")


@check("a3_xing", XING_SQL)
def _(t: Inputs):
    return shown(normalise(_xing(t), "xing", NOW))


@check("a4_indeed", expected(
    "'Indeed'", job_url="url || '/apply'", country="CASE WHEN page_id % 2 = 0 THEN 'Germany' ELSE '' END",
    city="CASE WHEN page_id % 2 = 0 THEN 'Ulm' ELSE '' END", kind="CASE WHEN page_id % 3 = 0 THEN 'Vollzeit' ELSE '-' END",
    ratings="page_id", rating="3.5", description=f"CASE WHEN page_id % 2 = 1 THEN 'plain' ELSE {PLAIN} END"))
def _(t: Inputs):
    return shown(normalise(landed(
        t, key=number().cast("string"), url=F.col("url"), jobUrl=F.concat("url", F.lit("/apply")), title=title(), dateOnIndeed=posted(),
        employer=F.struct(company().alias("name"), number().alias("ratingsCount"), F.lit(3.5).alias("ratingsValue")),
        location=F.when(number() % 2 == 0, F.struct(F.lit("Germany").alias("countryName"), F.lit("Ulm").alias("city"))),
        jobTypes=F.when(number() % 3 == 0, F.struct(F.lit("Vollzeit").alias("CF3CP"))),
        description=F.struct(F.when(number() % 2 == 1, "plain").otherwise("").alias("text"), F.col("html").alias("html"))),
        "indeed", NOW))


@check("a5_linkedin", expected(
    "'LinkedIn'", job_url="CASE WHEN page_id % 3 = 0 THEN url || '/apply' ELSE url END", country=COUNTRY_SQL,
    city=CITY_SQL, kind="'Contract'"))
def _(t: Inputs):
    return shown(normalise(landed(
        t, id=number().cast("string"), link=F.col("url"), applyUrl=F.when(number() % 3 == 0, F.concat("url", F.lit("/apply"))), title=title(),
        companyName=company(), location=location(), postedAt=posted(), employmentType=F.lit("Contract"),
        descriptionHtml=F.col("html")), "linkedin", NOW))


@check("a6_arbeitnow", expected(
    "'Arbeitnow'", city="CASE WHEN page_id % 5 = 3 THEN ' , ,' WHEN page_id % 5 = 0 THEN 'Berlin, BE, Deutschland' "
    "WHEN page_id % 5 = 1 THEN 'Germany' WHEN page_id % 5 = 2 THEN 'Hamburg' ELSE '' END",
    kind="CASE WHEN page_id % 3 = 0 THEN 'Full Time, Contract' ELSE '-' END", posted=EPOCH_SQL,
    where="page_id % 2 = 0 OR page_id % 3 = 1"))
def _(t: Inputs):
    return shown(normalise(landed(
        t, slug=number().cast("string"), url=F.col("url"), title=title(), company_name=company(), location=location(),
        description=F.col("html"), created_at=epoch(), remote=number() % 2 == 0,
        tags=F.when(number() % 3 == 1, F.array(F.lit("Senior"), F.lit("Fully-Remote"))),
        job_types=F.when(number() % 3 == 0, F.array(F.lit("Full Time"), F.lit("Contract"))).otherwise(
            F.array().cast("array<string>"))), "arbeitnow", NOW))


@check("a7_himalayas", expected(
    "'Himalayas'", country="CASE page_id % 3 WHEN 0 THEN 'Germany;Spain' WHEN 1 THEN 'Spain' ELSE '' END",
    kind="'Intern'", posted=EPOCH_SQL, description=f"CASE WHEN page_id % 2 = 0 THEN {PLAIN} ELSE '' END"))
def _(t: Inputs):
    def place(code: str, name):
        return F.struct(F.lit(code).alias("alpha2"), name.alias("name"), F.lit("s").alias("slug"))

    restrictions = F.when(number() % 3 < 2, F.array(
        place("DE", F.when(number() % 3 == 0, "Germany").otherwise("")), place("ES", F.lit("Spain"))))
    return shown(normalise(landed(
        t, guid=number().cast("string"), applicationLink=F.col("url"), title=title(), companyName=company(),
        description=F.when(number() % 2 == 0, F.col("html")), employmentType=F.lit("Intern"), pubDate=epoch() * 1000,
        locationRestrictions=restrictions), "himalayas", NOW))


@check("a8_remotive", expected("'Remotive'", country="CASE WHEN page_id % 2 = 0 THEN 'USA Only' ELSE '' END",
                               kind="'contract'"))
def _(t: Inputs):
    return shown(normalise(landed(
        t, id=number(), url=F.col("url"), title=title(), company_name=company(),
        candidate_required_location=F.when(number() % 2 == 0, "USA Only"), publication_date=posted(), job_type=F.lit("contract"),
        description=F.col("html")), "remotive", NOW))


@check("a9_weworkremotely", expected(
    "'We Work Remotely'", job_url="url",
    country="CASE page_id % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'Europe' ELSE CASE WHEN page_id % 8 < 4 THEN 'Germany' ELSE '' END END",
    city="CASE WHEN page_id % 8 < 4 THEN 'Berlin' ELSE 'Remote HQ' END",
    kind="CASE WHEN page_id % 2 = 0 THEN 'full-time' ELSE 'FT' END", where="page_id % 9 <> 5"))
def _(t: Inputs):
    # The field arrives as a list or as a scalar; the landed text keeps both.
    countries = (F.when(number() % 4 == 0, '["USA","Canada"]').when(number() % 4 == 1, '"Europe"').when(number() % 4 == 2, "[]").otherwise("null"))
    item = F.to_json(F.struct(
        number().cast("string").alias("id"), "url", title().alias("title"), company().alias("company"),
        F.when(number() % 8 < 4, "Berlin, Germany").otherwise("Remote HQ").alias("companyHq"), posted().alias("postedAt"),
        F.lit("FT").alias("employmentType"), F.when(number() % 2 == 0, "full-time").alias("employmentTypeNormalized"),
        F.col("html").alias("descriptionHtml"), F.when(number() % 9 == 5, "job_wwr_blocked").when(number() % 9 == 6, "job").alias("type")))
    whole = F.concat(F.lit('{"applicantCountries": '), countries, F.lit(", "), F.substring(item, 2, 10_000_000))
    return shown(normalise(t.pages.select(whole.alias("value")), "weworkremotely", NOW))
