"""Connected components in rounds of distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b long): component is the smallest node that links reach.

    Alternating large-star and small-star steps: in turn every node hooks its larger, then its smaller neighbours on to the
    least of them, until each component is one star; that takes about log2 of the longest path in rounds. Each round is
    staged. A hub's edges meet its single row of minima in a join, which adaptive execution can split, and minima are
    combined before the shuffle. Loops, repeated edges and an empty table are allowed; a node of loops only isn't returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        was, mark = mark, _mark(e)
        if was == mark:
            break
    stars = e.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
