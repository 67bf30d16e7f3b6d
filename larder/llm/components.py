"""Connected components of a table of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` in each row: every smaller neighbour, and the node itself, is linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node that ``links`` (a, b) reach from each linked node.

    Each round is written to the shared folder. The rounds needed grow with the logarithm of the longest chain;
    failing to settle within ``rounds`` raises. Hubs are handled by aggregates and joins, never by one task's list.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
