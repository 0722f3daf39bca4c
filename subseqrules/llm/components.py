"""Connected components of a large graph by contraction, in DataFrame operations.

In each round every node takes the smallest neighbour (itself included) as its parent, in the order of a hash of the
node, so that long chains of increasing ids shrink as fast as any. Edges move to the parents, and those within one parent
go. The number of nodes that still have edges falls by a constant factor on average, whatever the shape of the graph.
Each round is a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns (node, root) for every node with an edge; nodes of a component share the root."""
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        parent = best.select("node", F.least("m", order("node"))["n"].alias("parent"))
        steps.append(parent := durable(parent, "cc-parents"))
        up = edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        up = up.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b").where("pa <> pb")
        edges = durable(up.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps.pop()
    while steps:  # from the last round back: where a node's parent went
        later = labels.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        labels = steps.pop().join(later, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    return labels.select("node", F.col("parent").alias("root"))
