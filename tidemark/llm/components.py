"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the smallest member of the node's neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 20)), F.bit_xor(mixed)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not the smallest of its component.

    Every step is a join and a grouped minimum over the links; hot nodes are pre-aggregated and the joins may
    be split. Each step's links are written to the shared folder; the step before is deleted. Loops and
    repeated links do no harm; no links give no rows.
    """
    current = stored(edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "links")
    state = _state(current)
    while True:
        following = stored(_small_star(_large_star(current)), "links")
        drop(current)
        reached = _state(following)
        current = following
        if reached == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = reached
