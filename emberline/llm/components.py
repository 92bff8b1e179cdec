"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each end of ``edges`` (columns ``a``, ``b``): the smallest node of its component.

    Each round takes the smallest label around a node and then the label of that label, so the
    paths to the smallest node shrink at least by half and the rounds, however many the data
    needs, end by themselves; lineage is cut after every round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = cut(lower.join(labels.select(F.col("node").alias("low"), F.col("label").alias("next")), "low").select("node", "label", F.least("low", "next").alias("new")))
        settled = jump.where("new <> label").isEmpty()
        labels = jump.select("node", F.col("new").alias("label"))
        if settled:
            return labels
