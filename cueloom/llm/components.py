"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): each node's neighbours, the larger or the smaller ones, are tied to its least neighbour."""
    sides = edges
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("_least"))
    tied = sides.join(least, "a")
    if large:
        tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "_least").alias("b"))
    else:
        tied = tied.select("b", "_least").union(least.select("a", "_least")).toDF("a", "b")
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a, b). Loops and repeated edges do no harm.

    Every step is written to the shared folder, so a lost executor costs a step at most. Only two sums a step reach the driver.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now, before = textkit.written(now, "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = seen
        now = textkit.written(_stars(_stars(now, True), False), "edges")
