"""Connected components by minimum labels and pointer jumping; every step is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saithong.llm.common import cut, drop


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that it can reach. Repeated edges, loops and either direction are fine; no edges give no rows. cut: how steps are written."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "edges")
    table = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        labels = table.select("node", "label")
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        # A label is a node too: follow its own label, and tell it what its followers have seen.
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = cut(lower, "labels")
        told = lower.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("root_label"))
        own = lower.join(told, F.col("node") == F.col("root"), "left").select("node", "old", F.least("label", F.coalesce("root_label", "label")).alias("label"))
        own = cut(own, "labels")
        jump = own.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
        new = cut(own.join(jump, F.col("label") == F.col("l_node")).select("node", "old", F.col("l_label").alias("label")), "labels")
        drop(table, lower, own)
        table = new
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            drop(both)
            return new.select("node", "label")
