"""Connected components of an edge table: smallest labels spread and shortcut in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.frames import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then that label's own
    label, so long chains shorten by half. Every round ends as a written table. Rows with a null
    end are no edges.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = durable(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        heard = heard.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(heard, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        done = lower.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("label"), "old"
        )
        done = durable(done, "labels")
        labels = done.select("node", "label")
        if done.where("label <> old").limit(1).count() == 0:
            return labels
