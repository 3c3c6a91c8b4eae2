"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of ``links`` (a, b) the smallest node that it is linked with.

    In each round every node joins its smallest neighbour, or the one that this
    neighbour joins, and links between nodes that are one now are dropped. The
    smallest node of a component joins nobody, and is what is left of it. What
    remains of the links after a round is written out, which also cuts the lineage.
    """
    least, greatest = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(links.where("a <> b").select(least, greatest).distinct(), "edges")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("next"))
        onward = joined.select(F.col("node").alias("next"), F.col("next").alias("after"))
        joined = materialise(joined.join(onward, "next").select("node", F.col("after").alias("next")), "joined")
        moved = labels.join(joined.select(F.col("node").alias("label"), "next"), "label", "left")
        labels = materialise(moved.select("node", F.coalesce("next", "label").alias("label")), "labels")
        one = joined.select(F.col("node").alias("a"), F.col("next").alias("one"))
        other = joined.select(F.col("node").alias("b"), F.col("next").alias("other"))
        renamed = edges.join(one, "a").join(other, "b").where("one <> other").select(
            F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
        edges = materialise(renamed.distinct(), "edges")
        if edges.isEmpty():
            return labels
