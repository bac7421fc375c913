"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    around = _both_ways(edges)
    smallest = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = around.where("v > u").join(smallest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them. Edges have u > v."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(smallest.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node that an edge ``(u, v)`` of longs touches; the
    component is its smallest node. No edges give an empty table; loops are ignored.

    The number of rounds grows with the logarithm of the longest path; each round is
    written to the shared folder, so a lost executor repeats one round only. Rounds join by
    merging: a broadcast would bring the nodes of every round into the driver's memory.
    """
    current = stage(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _digest(current)
    while seen[0]:
        current = stage(_small_star(_large_star(current)), "edges")
        now = _digest(current)
        if now == seen:
            break
        seen = now
    root = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
