"""Bins and labels used as grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temporal gap bins and object-count bins of the pair protocol.
GAP_BINS = ("short", "medium", "long")
GAP_UPPER = {"short": 5, "medium": 11}
OBJECT_BINS = ((3, 4), (5, 6), (7, 8), (9, 10))


def gap_bin(gap: Column) -> Column:
    return (
        F.when(gap <= GAP_UPPER["short"], "short")
        .when(gap <= GAP_UPPER["medium"], "medium")
        .otherwise("long")
    )


def object_bin(count: Column) -> Column:
    chosen = None
    for low, high in OBJECT_BINS:
        test, label = count.between(low, high), f"{low:02d}-{high:02d}"
        chosen = F.when(test, label) if chosen is None else chosen.when(test, label)
    return chosen.otherwise(F.format_string("other-%02d", count.cast("int")))


def tertile(value: Column, low: Column, high: Column) -> Column:
    """Cut points belong to the bin below them."""
    return F.when(value <= low, "low").when(value <= high, "medium").otherwise("high")


def edge_bin(value: Column, edges: Column) -> Column:
    """How many distinct edges are at or below ``value`` (right-sided search)."""
    return F.size(F.filter(F.array_distinct(edges), lambda edge: edge <= value))
