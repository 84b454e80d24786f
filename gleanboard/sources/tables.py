"""Readers and writers of the stored tables."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import warnings
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.keys import render_list
from ..functions.text import file_slug, form_text
from ..operators.dedupe import keep_first
from ..schemas import EMBEDDING, POSTING_DEDUPED, PROGRESS, RUN, THEME_LISTS, VERDICT, conform

# Columns of the summary and of the preview.
SUMMARY_COLUMNS = ["key", "title", "employer_name", "city", "country",
                   "recruiter_score", "candidate_score", "error"]
PREVIEW_COLUMNS = ["title", "employer_name", "city", "country"]


# -- postings ----------------------------------------------------------------

def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Stored postings in the fixed schema; absent optional columns are null."""
    found = spark.read.parquet(path)
    return conform(found, POSTING_DEDUPED, keep=tuple(found.columns))


def write_parquet(df: DataFrame, path: str, drop: Iterable[str] = ("raw",)) -> None:
    df.drop(*drop).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, drop: Iterable[str] = ("raw", "description")) -> None:
    """CSV has no lists: they are rendered as text first."""
    flat(df.drop(*drop)).write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def flat(df: DataFrame) -> DataFrame:
    lists = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    dates = {f.name for f in df.schema if isinstance(f.dataType, T.DateType)}
    return df.select(*[
        render_list(F.col(c)).alias(c) if c in lists else
        F.date_format(c, "yy/MM/dd").alias(c) if c in dates else F.col(c) for c in df.columns])


def write_raw(df: DataFrame, path: str, platform: str = "source_platform") -> None:
    """Raw items as JSON lines, one folder per board, each with its file name."""
    (df.select(F.col(platform).alias("platform"), file_slug(F.col("employer_name"), F.col("title")).alias("name"), "raw")
     .write.mode("overwrite").partitionBy("platform").json(path))


def append_postings(earlier: DataFrame, new: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """An earlier table plus a new one; the earlier row wins."""
    both = earlier.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["_age", *order_by], drop=("_age",))


def export_scored(df: DataFrame, path: str) -> None:
    """Whole table as parquet, the table without heavy columns as CSV."""
    df.write.mode("overwrite").parquet(f"{path}/matches.parquet")
    write_csv(df, f"{path}/matches.csv")


def preview(df: DataFrame, columns: Sequence[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Listed columns that exist, lists as text, scores under friendly names."""
    kept = [c for c in columns if c in df.columns]
    out = df.select(*kept) if kept else df.drop("raw", "description")
    if "found_on" in out.columns:
        out = out.withColumn("found_on", render_list(F.col("found_on")))
    for old, new in (renames or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


# -- embeddings ---------------------------------------------------------------

#: Key buckets of the embedding table. A fixed value: a table keeps the number it began with.
KEY_BUCKETS = 64


def key_bucket(column: str = "key") -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(KEY_BUCKETS)).cast("int")


def read_embeddings(spark: SparkSession, path: str, model: str | None = None,
                    parts: bool = False) -> DataFrame:
    """The accumulated embedding table; an absent path is an empty table.

    ``parts`` adds ``bucket`` and ``build``, by which the files are laid out: a
    filter on them leaves all other files unread.
    """
    schema = T.StructType(list(EMBEDDING)).add("bucket", "integer").add("build", "string")
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)
    table = table if parts else table.drop("bucket", "build")
    return table.where(F.col("model") == model) if model else table


def append_embeddings(df: DataFrame, path: str, build: str | None = None) -> None:
    """Add the rows of a build, laid out by key bucket.

    A build that is written again under its name replaces its own rows, so a retry
    stores nothing twice; without a name every call is a build of its own.
    """
    rows = conform(df, EMBEDDING).withColumns({"bucket": key_bucket(), "build": F.lit(build or f"b-{uuid.uuid4().hex}")})
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "build").parquet(path))


# -- verdicts and runs ---------------------------------------------------------

def write_verdicts(records: DataFrame, path: str, bucket: int = 0) -> None:
    """One partition per run, pass and bucket; writing a bucket again replaces it.

    Rows with a column ``bucket`` go to that one, others to the given one."""
    own = F.col("bucket") if "bucket" in records.columns else F.lit(bucket)
    (conform(records.withColumn("bucket", own), VERDICT, keep=("bucket",))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "pass", "bucket").parquet(path))


def read_verdicts(spark: SparkSession, path: str, run_id: str | None = None, usable: bool = False) -> DataFrame:
    """Stored verdicts; ``usable`` leaves out the errored ones (a cache miss)."""
    records = spark.read.schema(VERDICT).parquet(path).select(*VERDICT.names)
    if run_id is not None:
        records = records.where(F.col("run_id") == run_id)
    return records.where(F.coalesce("error", F.lit("")) == "") if usable else records


def mark_finished(spark: SparkSession, path: str, run_id: str, name: str, bucket: int, buckets: int,
                  rows: int, failed: int) -> None:
    """Note that a bucket of a pass is stored. Readers of the verdicts do not see this folder."""
    mark_buckets(spark, path, [(run_id, name, bucket, buckets, rows, failed)])


def mark_buckets(spark: SparkSession, path: str, notes: Sequence[tuple]) -> None:
    """Note several stored buckets at once."""
    spark.createDataFrame(list(notes), PROGRESS).coalesce(1).write.mode("append").parquet(f"{path}/_progress")


def read_progress(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """One row per finished bucket: run, pass, bucket, number of buckets, rows and failed rows."""
    try:
        found = spark.read.schema(PROGRESS).parquet(f"{path}/_progress")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], PROGRESS)
    if run_id is not None:
        found = found.where(F.col("run_id") == run_id)
    # A bucket that was finished again is noted again: the fullest note counts.
    return found.groupBy("run_id", "pass", "bucket").agg(
        F.max("buckets").alias("buckets"), F.max("rows").alias("rows"), F.min("failed").alias("failed"))


def verdict_preview(records: DataFrame, postings: DataFrame) -> DataFrame:
    """Records with the posting shown beside them, joined when read."""
    return records.join(postings.select("key", *PREVIEW_COLUMNS), "key", "left")


def write_match(result: DataFrame, profiles: DataFrame, path: str) -> None:
    """Match artefacts: whole table, summary of the columns that exist, profiles."""
    result.write.mode("overwrite").parquet(f"{path}/selected.parquet")
    write_csv(result.select(*[c for c in SUMMARY_COLUMNS if c in result.columns]), f"{path}/summary.csv", ())
    profiles.write.mode("overwrite").json(f"{path}/profiles.json")


def run_id(model: str, top_n: int, keep_pct: float, started_at: dt.datetime) -> str:
    """slug(model)__n<top_n>__keep<pct>__<timestamp>: a fixed format."""
    name = re.sub("[^a-zA-Z0-9]+", "-", model).strip("-").lower() or "x"
    return f"{name}__n{top_n}__keep{keep_pct:g}__{started_at:%Y%m%d-%H%M%S}"


def run_id_column(model: Column, top_n: Column, keep_pct: Column, started_at: Column) -> Column:
    """``run_id`` of the rows of a table of runs; ``keep_pct`` has six digits at most."""
    name = F.lower(F.btrim(F.regexp_replace(model, "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    keep = F.regexp_replace(keep_pct.cast("double").cast("decimal(12,6)").cast("string"), r"\.?0+$", "")
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), F.lit("x")), F.lit("__n"), top_n.cast("string"), F.lit("__keep"), keep,
                    F.lit("__"), F.date_format(started_at, "yyyyMMdd-HHmmss"))


def register_run(spark: SparkSession, path: str, run: str, started_at: dt.datetime, settings: dict,
                 profiles: DataFrame | None = None) -> None:
    """One row in the run table; an empty path switches it off.

    The profiles of a run are stored beside the row, keyed by the run. Each run has
    partitions of its own: registering it again replaces them.
    """
    if not path:
        return
    text = json.dumps(settings, sort_keys=True, default=str)
    where = f"{path}/profiles"
    row = spark.createDataFrame([(run, started_at, text)], "run_id string, started_at timestamp, settings string")
    row = row.withColumn("settings_hash", F.substring(F.sha1("settings"), 1, 12)).withColumn(
        "profiles", F.lit(where if profiles is not None else None).cast("string"))
    own = {"mode": "overwrite", "partitionOverwriteMode": "dynamic", "partitionBy": "run_id"}
    conform(row, RUN).write.save(f"{path}/runs", "parquet", **own)
    if profiles is not None:
        profiles.withColumn("run_id", F.lit(run)).write.save(where, "parquet", **own)


def recent_runs(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    return spark.read.schema(RUN).parquet(f"{path}/runs").orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def previous_run(spark: SparkSession, path: str, explicit: str | None, configured: str | None = None) -> str | None:
    """The run to resume from: the argument beats the setting; an unknown run
    gives a warning and a fresh start."""
    wanted = explicit or configured
    if not wanted:
        return None
    try:
        known = not read_verdicts(spark, path, wanted).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = False
    if not known:
        warnings.warn(f"nothing is stored under run {wanted!r}: every pass starts anew", stacklevel=2)
        return None
    return wanted


# -- profiles ------------------------------------------------------------------

def profile_columns(text: str = "value", profile_id: str = "profile_id") -> list:
    """Profile fields of a JSON text column. A blank text is an empty profile,
    a scalar in a list slot a one-item list, null an empty list."""
    from ..functions.verdicts import text_field, theme_list

    v = F.try_parse_json(F.when(F.trim(text) != "", F.col(text)).otherwise("{}"))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    problem = F.when(v.isNull(), "invalid JSON").when(~is_object, "a profile is a JSON object")
    return [F.col(profile_id), *[theme_list(v, n).alias(n) for n in THEME_LISTS],
            text_field(v, "search_query").alias("search_query"), problem.alias("problem")]


def read_profiles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One profile per file; the file name is its id."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("profile_id"))
    parsed = files.select(*profile_columns())
    if strict:
        checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "profile_id", "problem")))
        parsed = parsed.where(checked.cast("string").isNull())
    return parsed.drop("problem") if strict else parsed


def replace_themes(profiles: DataFrame, themes: DataFrame) -> DataFrame:
    """Put edited theme lists back into the profiles; other fields stay.

    ``themes``: profile_id and the four lists as they come from a form.
    """
    clean = themes.select("profile_id", *[
        F.filter(F.transform(n, form_text), lambda t: t != "").alias(f"_{n}") for n in THEME_LISTS])
    return profiles.join(clean, "profile_id", "left").select(*[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in THEME_LISTS else F.col(c) for c in profiles.columns])
