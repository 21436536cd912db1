"""Connected components over an edge table, by alternating large-star and small-star rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component): the smallest node that each node of an edge can reach.

    Each round is a table in the shared folder, so neither the lineage nor what a lost executor held matters. Rounds
    grow with the logarithm of the longest path. Every group is reduced to its minimum before it is shuffled, and
    edges go back to their groups by joins, whose large partitions adaptive execution splits."""
    edges = materialise(_down(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).distinct(), "edges")
    before = None
    while True:
        large = _large_star(edges)
        edges = materialise(_small_star(large), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    # Nothing changes any more: every edge goes from a node to the smallest of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Every edge from its greater to its smaller end; loops go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _down(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))).distinct()
