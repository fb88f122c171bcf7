"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least of them; edges are (a, b) with a > b.

    large: the neighbours above a node; else the node and those below it. The least neighbour is found by an
    aggregate that combines before the shuffle, so a hub's edges don't meet in one task.
    """
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    if large:
        least = least.select("hub", F.least("hub", "m").alias("m"))
        out = around.join(least, F.col("a") == F.col("hub")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = around.join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("hub").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Large and small stars by turns until all edges point at roots, which takes a number of rounds that grows with the
    logarithm of the longest path. Each round is stored in the checkpoint folder.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, True), False))
        # a star forest: the edges are the same after a round
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = row["n"], row["h"]
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
