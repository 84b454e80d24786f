"""New landed files to unified postings, with the batch field maps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.boards import board, located_lines, normalise, numbered


def landing_stream(spark: SparkSession, name: str, path: str, now: dt.datetime,
                   files_per_batch: int | None = None) -> DataFrame:
    """A stream of postings of one board; the schema is fixed, nothing is inferred."""
    board(name)
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalise(reader.text(path), name, now)


def landing_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of landed lines with their file and block; a micro-batch turns them into postings."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return located_lines(reader.text(path))


def ordered_postings(name: str, now: dt.datetime) -> Callable[[DataFrame], DataFrame]:
    """Turns a micro-batch of landed lines into postings of a board with the ``row_ord`` that a batch
    reader gives them, so that the same copy of a job comes first on both ways."""
    board(name)
    return lambda lines: normalise(numbered(lines), name, now).withColumn("actor", F.lit(name))


def write_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table; the file sink writes each batch exactly once."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())
