"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    down = linked.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return down.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order -> node, component: the least node of its component. Nodes without an edge are left out.

    Each round is two joins over edges that grow shorter; it ends when a round changes nothing. No set
    of links or labels reaches the driver; a node with very many links is split by the join.
    """
    edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        last, edges = edges, kept(_small_star(_large_star(edges)))
        forget(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
