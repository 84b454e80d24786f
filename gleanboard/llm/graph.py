"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Labels sink along links and along the labels themselves, so the rounds grow
    with the logarithm of the longest chain. A round writes one row per node to
    the shared checkpoint folder; nothing but a count reaches the driver. Rows
    with a null end are no links.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = settle(one.union(one.select("v", "u")).distinct())
    labels = settle(edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("component")))
    while True:
        heard = (edges.join(labels, edges["v"] == labels["node"])
                 .groupBy("u").agg(F.min("component").alias("heard")))
        lower = labels.join(heard, labels["node"] == heard["u"]).select(
            "node", F.col("component").alias("before"), F.least("component", "heard").alias("component"))
        up = labels.select(F.col("node").alias("top"), F.col("component").alias("above"))
        after = settle(lower.join(up, lower["component"] == up["top"], "left").select(
            "node", "before", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
