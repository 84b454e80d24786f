"""Country names, locations and country codes."""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from string import ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import blank_to_null, strip

# Languages whose country names are recognised.
LANGUAGES = ["de", "en", "fr", "it", "nl", "es", "pl"]

# Informal names the locale data does not list.
INFORMAL = {
    "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom",
    "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom",
    "u.s.": "United States", "u.s.a.": "United States", "us": "United States",
    "america": "United States", "uae": "United Arab Emirates", "holland": "Netherlands",
    "czechia": "Czech Republic", "south korea": "South Korea", "korea": "South Korea",
}
# Ours: one form per country, and the abbreviation everybody writes.
ONE_FORM = {"Czechia": "Czech Republic"}
EXTRA = {"usa": "United States", "czech republic": "Czech Republic"}

# Country code to name as the unified board expects it.
CODE_TO_NAME = {
    "ar": "Argentina",
    "au": "Australia",
    "at": "Austria",
    "bh": "Bahrain",
    "bd": "Bangladesh",
    "be": "Belgium",
    "bg": "Bulgaria",
    "br": "Brazil",
    "ca": "Canada",
    "cl": "Chile",
    "cn": "China",
    "co": "Colombia",
    "cr": "Costa Rica",
    "hr": "Croatia",
    "cy": "Cyprus",
    "cz": "Czech Republic",
    "dk": "Denmark",
    "ec": "Ecuador",
    "eg": "Egypt",
    "ee": "Estonia",
    "fi": "Finland",
    "fr": "France",
    "de": "Germany",
    "gr": "Greece",
    "hk": "Hong Kong",
    "hu": "Hungary",
    "in": "India",
    "id": "Indonesia",
    "ie": "Ireland",
    "il": "Israel",
    "it": "Italy",
    "jp": "Japan",
    "kw": "Kuwait",
    "lv": "Latvia",
    "lt": "Lithuania",
    "lu": "Luxembourg",
    "my": "Malaysia",
    "mt": "Malta",
    "mx": "Mexico",
    "ma": "Morocco",
    "nl": "Netherlands",
    "nz": "New Zealand",
    "ng": "Nigeria",
    "no": "Norway",
    "om": "Oman",
    "pk": "Pakistan",
    "pa": "Panama",
    "pe": "Peru",
    "ph": "Philippines",
    "pl": "Poland",
    "pt": "Portugal",
    "qa": "Qatar",
    "ro": "Romania",
    "sa": "Saudi Arabia",
    "sg": "Singapore",
    "sk": "Slovakia",
    "si": "Slovenia",
    "za": "South Africa",
    "kr": "South Korea",
    "es": "Spain",
    "se": "Sweden",
    "ch": "Switzerland",
    "tw": "Taiwan",
    "th": "Thailand",
    "tr": "Turkey",
    "ua": "Ukraine",
    "ae": "United Arab Emirates",
    "gb": "United Kingdom",
    "uk": "United Kingdom",
    "us": "United States",
    "uy": "Uruguay",
    "ve": "Venezuela",
    "vn": "Vietnam",
}


@lru_cache(maxsize=1)
def _alias_rows() -> tuple[tuple[str, str], ...]:
    """Alias to English name, from the locale data of the JVM.

    Rule: every two-letter code with an English name, under its code and its
    name in each language; informal names override. About 1,500 rows.
    """
    locale = SparkSession.active()._jvm.java.util.Locale
    english = locale("en")
    names = {}
    for a, b in product(ascii_uppercase, repeat=2):
        name = locale("", a + b).getDisplayCountry(english)
        if name != a + b:
            names[a + b] = ONE_FORM.get(name, name)
    aliases = {code.lower(): name for code, name in names.items()}
    for language in LANGUAGES:
        shown = locale(language)
        for code, name in names.items():
            aliases[locale("", code).getDisplayCountry(shown).lower()] = name
    return tuple(sorted({**aliases, **INFORMAL, **EXTRA}.items()))


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, country); its size is fixed by the rule, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(
        pd.DataFrame(_alias_rows(), columns=["alias", "canonical"]), "alias string, canonical string"))


def with_country(df: DataFrame, source: str, target: str, aliases: DataFrame) -> DataFrame:
    """Canonical country name; unknown names pass through stripped, null gives ''."""
    kept = [c for c in df.columns if c != target]
    name = strip(F.coalesce(F.col(source), F.lit("")))
    return (df.withColumn("_name", name)
            .join(aliases, F.lower("_name") == F.col("alias"), "left")
            .select(*kept, F.coalesce("canonical", "_name").alias(target)))


def with_location(df: DataFrame, source: str, city: str, country: str, aliases: DataFrame) -> DataFrame:
    """Split 'City, Region, Country' into city and canonical country.

    The last part is the only one ever looked up, so one join serves both the
    two-part form and a lone country name.
    """
    kept = [c for c in df.columns if c not in (city, country)]
    text = F.col(source)
    text = F.when(F.startswith(text, F.lit("{")), F.get_json_object(text, "$.raw")).otherwise(text)
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda p: p != "")
    n = F.size("_parts")
    last = F.coalesce(F.try_element_at("_parts", F.lit(-1)), F.lit(""))
    return (df.withColumn("_parts", parts).withColumn("_last", last)
            .join(aliases, F.lower("_last") == F.col("alias"), "left")
            .select(
                *kept,
                F.when(n >= 2, F.get("_parts", F.lit(0)))
                .when((n == 1) & F.col("canonical").isNull(), F.col("_last")).otherwise("").alias(city),
                F.when(n >= 2, F.coalesce("canonical", "_last"))
                .when(n == 1, F.coalesce("canonical", F.lit(""))).otherwise("").alias(country)))


def resolve_country_code(c: Column) -> Column:
    """Name of a known code; anything else passes through as it was written."""
    table = F.create_map(*[F.lit(x) for pair in CODE_TO_NAME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), c, F.lit(""))


def after_last_comma(c: Column) -> Column:
    """Stripped text after the last comma; '' where there is none."""
    return F.when(F.contains(c, F.lit(",")), strip(F.substring_index(c, ",", -1))).otherwise("")


def before_first_comma(c: Column) -> Column:
    return strip(F.substring_index(F.coalesce(c, F.lit("")), ",", 1))


def first_of(c: Column) -> Column:
    """First entry of a JSON list, or the scalar itself; missing gives ''."""
    items = F.from_json(c, "array<string>")
    listed = F.startswith(F.ltrim(c), F.lit("["))
    return F.when(listed, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def joined_or_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", "))


def joined_field(c: Column, field: str) -> Column:
    """';'-joined non-blank values of one field of an array of structs."""
    values = F.transform(c, lambda s: blank_to_null(s[field]))
    return F.coalesce(F.array_join(F.filter(values, lambda v: v.isNotNull()), ";"), F.lit(""))
