"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm._shared import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, comp for each node of edges (u, v: long): comp is the smallest node reachable.

    Every round takes the smallest label around each node, then the label of that
    label, so the rounds follow the logarithm of a path's length, not the
    length. A node of very many edges is a skewed join, which Spark splits.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = tables.keep(both)
    labels = tables.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("comp")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        stepped = lower.join(jump, "comp").select("node", "before", F.least("comp", "next").alias("comp"))
        now = tables.keep(stepped)
        tables.drop(labels)
        labels = now
        if now.filter("comp != before").isEmpty():
            tables.drop(both)
            return labels.select("node", "comp")
