"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreframe.llm.shared import hot_join, hot_keys, stored


def _least(edges: DataFrame, of: str, other: str) -> tuple[DataFrame, DataFrame]:
    """(the smallest other end of each node, the nodes with very many edges)."""
    least = stored(edges.groupBy(of).agg(F.min(other).alias("m"), F.count("*").alias("held")), "least")
    return least.drop("held"), hot_keys(least, of, "held")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, hot = _least(both, "a", "b")
    met = hot_join(both.where("b > a"), least.withColumn("m", F.least("m", "a")), "a", hot, "b", "inner")
    return met.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least, hot = _least(edges, "b", "a")
    tied = hot_join(edges, least, "b", hot, "a", "inner").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
    return tied.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node of the component; nodes without edges don't appear.

    Only minima are grouped, and the edges of nodes with very many neighbours are dealt over several tasks; each step
    is written to the shared folder. Self-edges, repeated edges, nulls and either direction are fine.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen, edges = state, stored(_small(stored(_large(edges), "edges")), "edges")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
