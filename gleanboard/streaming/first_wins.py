"""Duplicate resolution on a stream.

``first_by_key`` forwards the first row of a key and needs no table; it
promises the set of keys. ``ProvenanceLog`` also keeps the survivor rule and
the sources of all copies: every micro-batch adds its partial groups, and reading
combines them, since both aggregates are associative. From time to time what is
there becomes a new generation, so a reader never goes through all batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.keys import match_key
from ..operators.dedupe import has_match_parts
from ..operators.filters import effective_source


def first_by_key(stream: DataFrame, time: str, keys: Sequence[str], lateness: str, spread: int = 16) -> DataFrame:
    """One row per key. A copy later than ``lateness`` may come out again.

    Copies of a key are first thinned out in ``spread`` salted parts, so that
    a key with very many copies does not fill one state partition's input.
    """
    keys = list(keys)
    stream = stream.withWatermark(time, lateness)
    if spread > 1:
        others = [c for c in stream.columns if c not in keys]
        stream = (stream.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(spread)))
                  .dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt"))
    return stream.dropDuplicatesWithinWatermark(keys)


def partial_groups(batch: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Groups of one batch: first row by order, distinct sources, copies.

    A row with a blank part is a group of its own, as in the batch rule.
    """
    payload = [c for c in batch.columns if c not in ("actor", "source_platform")]
    alone = F.when(~has_match_parts(), F.struct(*order_by, F.xxhash64(*batch.columns).alias("row")))
    rest = [c for c in payload if c not in order_by]
    return (batch.select(match_key().alias("match_key"), alone.alias("alone"), effective_source().alias("source"),
                         F.struct(*order_by, *rest).alias("row"))
            .groupBy("match_key", "alone")
            .agg(F.min("row").alias("first_row"), F.collect_set("source").alias("sources"),
                 F.count(F.lit(1)).alias("copies")))


GROUPS = ["match_key", "alone"]
#: Micro-batches between two generations.
COMPACT_EVERY = 10


def merged_groups(groups: DataFrame) -> DataFrame:
    """Partial groups of the same job as one; the result can be merged again.

    Rows that stand alone have nothing to be merged with: they pass by and are neither moved nor sorted."""
    merged = groups.where("alone IS NULL").groupBy(*GROUPS).agg(
        F.min("first_row").alias("first_row"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.sum("copies").alias("copies"))
    return merged.unionByName(groups.where("alone IS NOT NULL").select(*merged.columns))


class ProvenanceLog:
    """Table of partial groups, merged when read.

    Every micro-batch writes its groups to a partition of its own, ``tail``. After
    ``compact_every`` batches the last generation and the tail are merged into a
    new generation: a folder of its own, noted in ``generations`` when it is whole.
    A reader takes the last noted generation and the batches behind it, so its work
    does not grow with the number of batches. A batch that is repeated replaces its
    partition; what a generation holds already is not read from the tail.
    """

    def __init__(self, path: str, order_by: Sequence[str], compact_every: int = COMPACT_EVERY):
        self.path, self.order_by, self.compact_every = path, list(order_by), compact_every

    def start(self, stream: DataFrame, checkpoint: str,
              prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
        """``prepare`` turns a micro-batch into postings, where the stream cannot (positions of lines)."""
        log = self

        def store(batch: DataFrame, batch_id: int) -> None:
            rows = batch if prepare is None else prepare(batch)
            (partial_groups(rows, log.order_by).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(f"{log.path}/tail"))
            if (batch_id + 1) % log.compact_every == 0:
                log.compact(batch.sparkSession, batch_id)

        return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    def _noted(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema("upto bigint, folder string").parquet(f"{self.path}/generations")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _attempts(self, spark: SparkSession, upto: int) -> int:
        noted = self._noted(spark)
        return 0 if noted is None else noted.where(F.col("upto") == upto).count()

    def generation(self, spark: SparkSession, before: int | None = None) -> tuple[int, str | None]:
        """(last batch in it, folder) of the newest generation; -1 and None before the first one."""
        noted = self._noted(spark)
        if noted is None:
            return -1, None
        if before is not None:
            noted = noted.where(F.col("upto") < before)
        last = noted.agg(F.max(F.struct("upto", "folder")).alias("g")).first()["g"]
        return (-1, None) if last is None else (last["upto"], last["folder"])

    def groups(self, spark: SparkSession, upto: int, folder: str | None, until: int | None = None) -> DataFrame:
        """The groups of a generation and of the batches behind it, not merged."""
        tail = spark.read.parquet(f"{self.path}/tail").where(F.col("batch_id") > upto)
        if until is not None:
            tail = tail.where(F.col("batch_id") <= until)
        tail = tail.drop("batch_id")
        return tail if folder is None else spark.read.parquet(f"{self.path}/{folder}").unionByName(tail)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Write the generation that ends with a batch and note it. A repeated call notes a folder with the same content."""
        before, folder = self.generation(spark, before=upto)
        # Of the folders noted for a batch the one noted last is read: names rise with the attempts.
        name = f"generation-{upto}-{self._attempts(spark, upto):06d}-{uuid.uuid4().hex[:8]}"
        merged_groups(self.groups(spark, before, folder, upto)).write.parquet(f"{self.path}/{name}")
        (spark.createDataFrame([(upto, name)], "upto bigint, folder string").coalesce(1)
         .write.mode("append").parquet(f"{self.path}/generations"))

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged table of everything stored so far."""
        merged = merged_groups(self.groups(spark, *self.generation(spark)))
        found = merged.select("match_key", "alone", "first_row.*", F.col("sources").alias("found_on"), "copies")
        # Equal rows with a blank part are all kept; jobs with one copy pass by.
        one = (F.col("alone").isNull()) | (F.col("copies") == 1)
        many = found.where(~one).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("_copy")
        return found.where(one).unionByName(many).drop("alone", "copies")
