"""Extending the embedding table from a stream of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.dedupe import keep_first
from ..plans.index import BATCH, Embedder, embed_new
from ..session import settle
from ..sources.tables import append_embeddings, key_bucket, read_embeddings


def index_stream(stream: DataFrame, path: str, checkpoint: str, embedder: Embedder, model: str,
                 batch_size: int = BATCH) -> StreamingQuery:
    """Each micro-batch embeds the keys the table does not hold yet.

    The table is laid out by key bucket. A micro-batch lists the buckets of its
    own keys (at most KEY_BUCKETS numbers) and reads those only. It writes under
    a build name of its own; a repeated batch ignores what its first attempt wrote
    and replaces it, so every key is stored once.
    """

    def extend(batch: DataFrame, batch_id: int) -> None:
        build = f"s-{batch_id}"
        once = settle(keep_first(settle(batch), [c for c in batch.columns if c != "key"], by=["key"]))
        fresh = embed_new(once, stored_for(once, path, model, build), embedder, model, batch_size)
        append_embeddings(fresh.where(F.col("embedding").isNotNull()), path, build)

    return (stream.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_for(postings: DataFrame, path: str, model: str, without: str = "") -> DataFrame:
    """The stored rows in the key buckets of a (stored) table, but for those of one build."""
    touched = [r[0] for r in postings.select(key_bucket()).distinct().collect()]
    stored = read_embeddings(postings.sparkSession, path, model, parts=True)
    return stored.where(F.col("bucket").isin(touched) & ~F.col("build").eqNullSafe(F.lit(without)))
