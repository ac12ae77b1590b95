"""Connected components of a table of links, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links (a, b) as node, label: the smallest node of its component.

    Each round, a node takes the smallest label among its neighbours and then its label's label, so the
    rounds grow with the logarithm of a component's width. The minima are partly taken before the
    shuffle, the joins are ones that adaptive execution splits where a node has very many links. Each
    round ends in a checkpoint in the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    edges = checkpointed(both.union(links.select("a", F.col("a").alias("b"))).union(links.select(F.col("b").alias("a"), "b")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        old = labels.select(F.col("node").alias("a"), F.col("label").alias("old"))
        near = checkpointed(near.join(old, "a"))
        if near.where("near <> old").isEmpty():
            return labels
        jump = near.select(F.col("a").alias("over"), F.col("near").alias("next"))
        labels = checkpointed(near.join(jump, F.col("near") == F.col("over")).select(F.col("a").alias("node"), F.least("near", "next").alias("label")))
