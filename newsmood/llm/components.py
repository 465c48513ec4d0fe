"""Connected components of a graph given by its edges, by contraction: every round at least halves what is left.

Every node points to its smallest neighbour or itself; pointers are followed to their ends by doubling; edges are
rewritten to the ends and those within one end are dropped. What a round makes is written to the shared folder, which
cuts the lineage. No node's neighbours are gathered: the smallest comes from a map-side aggregate, and the joins on
hot nodes are equi joins that Spark splits at run time. They are never broadcasts: Spark would go by the sizes of packed
files of numbers, which are many times smaller than their rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.sources.shared import materialise


def _followed(parent: DataFrame) -> DataFrame:
    """(node, top): pointers followed to the node that points to itself."""
    while True:
        up = parent.select(F.col("node").alias("top"), F.col("top").alias("above"))
        parent = materialise(parent.hint("merge").join(up, "top").select(
            "node", F.col("above").alias("top"), (F.col("above") != F.col("top")).alias("moved")), "pointers")
        if parent.where("moved").isEmpty():
            return parent.select("node", "top")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge in (a, b); component is the smallest node reachable."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "edges")
    whole = None
    while whole is None or not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), "b").unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        tops = _followed(materialise(both.groupBy("node").agg(F.min("b").alias("b"))
                                     .select("node", F.least("node", "b").alias("top")), "pointers"))
        if whole is None:
            whole = tops
        else:
            above = tops.select(F.col("node").alias("top"), F.col("top").alias("above"))
            whole = (whole.hint("merge").join(above, "top", "left")
                     .select("node", F.coalesce("above", "top").alias("top")))
        for end in ("a", "b"):
            edges = (edges.hint("merge").join(tops.withColumnRenamed("node", end), end).drop(end)
                     .withColumnRenamed("top", end))
        edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .distinct(), "edges")
    return whole.select("node", F.col("top").alias("component"))
