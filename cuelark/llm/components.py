"""Connected components by alternating large-star and small-star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelark.llm.joins import spread_join
from cuelark.llm.storage import cut, release


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("_c"))
    met = spread_join(both.where("b > a"), least.select("a", "m"), ["a"], counts=least, rows=2 * rows)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_c"))
    met = spread_join(edges, least.select("a", "m"), ["a"], counts=least, rows=rows)
    moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its smallest node.

    The two operations alternate until the edges no longer change; they are then
    stars around each component's smallest node. Every step is a group-by and a
    join in which a star's rows are dealt over several tasks where it is large, so
    no component is gathered anywhere; only counts, a checksum and the names of the
    largest stars (1,000 at most) come to the driver. Loops (a = b) and repeated
    edges make no difference, edges with a null end are left out, and an empty
    table gives an empty one.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    named = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen, mark = state(named), None
    while seen != mark and seen[0]:
        mark = seen
        named = cut(_large_star(named, seen[0]))
        named = cut(_small_star(named, seen[0]))
        seen = state(named)
        release(edges.sparkSession)
    nodes = named.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(named.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
