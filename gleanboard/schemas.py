"""Fixed table schemas. Every reader returns these, also for empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


TEXTS = T.ArrayType(T.StringType())
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _table(**fields: str | T.DataType) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


POSTING = _table(
    platform_url="string", job_url="string", title="string", employer_name="string",
    employer_ratings_count="long", employer_rating="double", country="string", city="string",
    posted_at="date", employment_type="string", description="string", source_platform="string",
    raw="string")
COLLECTED = _table(actor="string", source_ord="integer", row_ord="string")
POSTING_DEDUPED = _table(
    platform_url="string", job_url="string", title="string", employer_name="string",
    employer_ratings_count="long", employer_rating="double", country="string", city="string",
    posted_at="date", employment_type="string", description="string", raw="string",
    found_on=TEXTS, key="string", match_key="string")
EMBEDDING = _table(key="string", model="string", embedding=T.ArrayType(T.FloatType()),
                   document="string", metadata=TEXT_MAP)
PROFILE = _table(
    profile_id="string", cv_text="string", role_themes=TEXTS, must_have_themes=TEXTS,
    nice_to_have_themes=TEXTS, disqualifiers=TEXTS, search_query="string")
VERDICT = _table(profile_id="string", key="string", payload="string", error="string",
                 run_id="string", **{"pass": "string"})
# A finished bucket of a pass.
PROGRESS = _table(run_id="string", **{"pass": "string"}, bucket="integer", buckets="integer", rows="long", failed="long")
RUN = _table(run_id="string", started_at="timestamp", settings="string", settings_hash="string",
             profiles="string")

THEME_LISTS = ["role_themes", "must_have_themes", "nice_to_have_themes", "disqualifiers"]
RATINGS = ["technical_match", "seniority_match", "transferability", "trajectory", "soft_skills"]
VERDICT_LISTS = ["themes_matched", "must_haves_met", "must_haves_missing", "disqualifiers_triggered"]


def conform(df: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select the columns of ``schema``; absent ones become typed nulls."""
    present = set(df.columns)
    cols: list[Column] = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    return df.select(*cols, *[c for c in keep if c in present and c not in schema.names])
