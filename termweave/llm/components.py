"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def _roots(target: DataFrame) -> DataFrame:
    """target (node, to) with every pointer moved to the end of its chain, doubling its reach each time."""
    while True:
        ahead = target.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = materialised(target.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        target = jumped.select("node", "to")
        if jumped.where("moved").isEmpty():
            return target


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Each round every node points to its smallest neighbour (or itself), pointers are followed to
    their ends, and the graph is contracted to these. A node that is no local minimum disappears,
    so at least half of a component's nodes go each round. The smallest neighbour is a map-side
    aggregate; the other steps join two tables that were written before, so that Spark can split
    the rows of a node with many neighbours.
    """
    left = materialised(edges.where("a <> b").select("a", "b").distinct())
    moved = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        target = materialised(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("to"))
        )
        target = _roots(target)
        if moved is None:
            moved = target.withColumnRenamed("to", "component")
        else:
            step = target.withColumnRenamed("node", "component")
            moved = materialised(moved.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        ends_a = left.join(target.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        ends_b = ends_a.join(target.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = materialised(
            ends_b.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return moved
