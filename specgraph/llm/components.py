"""Connected components by alternating large-star and small-star steps.

Every step maps a set of edges to a set of at most as many edges with the same components; the
edges end as stars around each component's smallest node. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node that it is connected with.

    Self-loops and rows with nulls are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = _util.cut(edges, "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, _util.cut(small, "edges")
        _util.drop(last)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
