"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two shuffles of the edge table, the table is written to the shared folder between rounds,
and only the count of changed edges comes to the driver.  The large-star step sends the neighbours of a
node to its smallest neighbour by a joined minimum and never gathers a neighbourhood in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = both.join(least, "u")
    if large:  # neighbours larger than the node move to the smallest one
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:  # smaller neighbours, and the node itself, move to the smallest one
        moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(least.select("u", F.col("low").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable from node by the links a-b.

    Nodes that no link touches, null ends and links from a node to itself aren't in the result.  An empty
    edge table gives an empty result.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u > v").distinct()
    current = stored(edges, "edges")
    mark = None
    for _ in range(rounds):
        following = stored(_star(_star(current, True), False), "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(current)
        current = following
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
