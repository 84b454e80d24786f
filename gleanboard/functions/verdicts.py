"""From the text a model returns to clean verdict columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import RATINGS, THEME_LISTS, VERDICT_LISTS

RELAXED = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true",
           "allowComments": "true", "allowNonNumericNumbers": "true"}
# A quoted text as it stands, or a comma before a closing bracket.
QUOTED_OR_COMMA = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|\'[^\'\\]*+(?:\\.[^\'\\]*+)*+\')|,(?=\s*[}\]])'
UNREADABLE = "could not parse model JSON output"
NUMERIC_TYPES = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def loose_json(text: Column) -> Column:
    """Parse strictly, then relaxed, then without trailing commas (commas inside
    quoted texts stay).

    Gives a variant, null where no form parses or the text does not end like
    a JSON object.
    """
    whole = F.when(text.rlike(r"(?:\}|\*/|//[^\n]*)\s*$"), text)
    return F.coalesce(
        F.try_parse_json(whole),
        F.from_json(whole, "variant", RELAXED),
        F.from_json(F.regexp_replace(whole, QUOTED_OR_COMMA, "$1"), "variant", RELAXED),
    )


def json_error(text: Column, parsed: Column) -> Column:
    return F.when(text.isNull() | parsed.isNull(), F.lit(UNREADABLE))


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def rating(v: Column, name: str) -> Column:
    """A rating cut to 0-10. Not a number, also a quoted one, counts as 0."""
    number = F.try_variant_get(v, f"$.{name}", "double")
    truth = F.try_variant_get(v, f"$.{name}", "boolean")
    kind = _kind(v, name)
    value = F.when(kind.rlike(NUMERIC_TYPES), F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))) \
        .when(kind == "BOOLEAN", truth.cast("int").cast("double")).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), value)).cast("int")


def string_list(v: Column, name: str) -> Column:
    """A list of strings; missing, null or not a list gives the empty list."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"),
                      F.array().cast("array<string>"))


def text_field(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))


def decision(v: Column) -> Column:
    """``pass`` or ``reject`` as the model spelled it, else ''."""
    d = F.try_variant_get(v, "$.decision", "string")
    return F.when((_kind(v, "decision") == "STRING") & F.lower(d).isin("pass", "reject"), d).otherwise("")


def decision_problem(v: Column) -> Column:
    d = F.try_variant_get(v, "$.decision", "string")
    kind = _kind(v, "decision")
    return F.when(kind.isNull() | (kind != "STRING"), F.lit("decision is not a text")) \
        .when(~F.lower(d).isin("pass", "reject"), F.lit("decision is neither pass nor reject"))


def _failure(pass_name: str, key: Column, cause: Column) -> Column:
    return F.when(cause.isNotNull(), F.concat(F.lit(f"{pass_name} failed at key '"), key, F.lit("': "), cause))


def read_prescreen(v: Column, reply: Column, call_error: Column, key: Column) -> list[Column]:
    cause = F.coalesce(call_error, json_error(reply, v), decision_problem(v))
    return [F.when(cause.isNull(), decision(v)).otherwise("").alias("decision"),
            F.when(cause.isNull(), text_field(v, "prescreen_notes")).otherwise("").alias("prescreen_notes"),
            _failure("prescreen", key, cause).alias("error")]


def read_recruiter(v: Column, reply: Column, call_error: Column, key: Column) -> list[Column]:
    cause = F.coalesce(call_error, json_error(reply, v), not_an_object(v))
    good = cause.isNull()
    return [*[F.when(good, rating(v, r)).otherwise(0).alias(r) for r in RATINGS],
            F.when(good, text_field(v, "recruiter_notes")).otherwise("").alias("recruiter_notes"),
            _failure("recruiter", key, cause).alias("error")]


def read_candidate(v: Column, reply: Column, call_error: Column, key: Column) -> list[Column]:
    cause = F.coalesce(call_error, json_error(reply, v), not_an_object(v))
    empty = F.array().cast("array<string>")
    return [*[F.when(cause.isNull(), string_list(v, n)).otherwise(empty).alias(n) for n in VERDICT_LISTS],
            _failure("candidate", key, cause).alias("error")]


def read_profile(v: Column, reply: Column, call_error: Column, key: Column) -> list[Column]:
    cause = F.coalesce(call_error, json_error(reply, v), not_an_object(v))
    return [*[theme_list(v, n).alias(n) for n in THEME_LISTS],
            text_field(v, "search_query").alias("search_query"),
            _failure("profile", key, cause).alias("error")]


def not_an_object(v: Column) -> Column:
    return F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("reply is not a JSON object"))


def theme_list(v: Column, name: str) -> Column:
    """A theme slot: list as it is, scalar as a one-item list, null as empty."""
    kind = _kind(v, name)
    scalar = F.try_variant_get(v, f"$.{name}", "string")
    return F.when(kind.startswith("ARRAY"), string_list(v, name)) \
        .when(kind.isNotNull() & (kind != "VOID") & scalar.isNotNull(), F.array(scalar)) \
        .otherwise(F.array().cast("array<string>"))
