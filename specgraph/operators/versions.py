"""Differences between versions of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_id, status): added, removed, or modified in type, description or aliases; unchanged ones are left out."""
    def side(df, name):
        return df.select("node_id", F.struct("node_type", "description", F.array_sort(F.coalesce("aliases", F.array().cast("array<string>")))).alias(name))

    j = side(a, "a").join(side(b, "b"), "node_id", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return j.select("node_id", status.alias("status")).filter("status is not null")


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src_id, dst_id, rel_type, status): added or removed."""
    key = ["src_id", "dst_id", "rel_type"]
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return y.join(x, key, "left_anti").withColumn("status", F.lit("added")).unionByName(x.join(y, key, "left_anti").withColumn("status", F.lit("removed")))


def changed_workflow(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src_id, rel_type, before, after): pairs in both versions whose targets differ."""
    def targets(df, name):
        return df.groupBy("src_id", "rel_type").agg(F.array_sort(F.collect_set("dst_id")).alias(name))

    return targets(a, "before").join(targets(b, "after"), ["src_id", "rel_type"]).filter("before != after")


def summary(a_nodes: DataFrame, b_nodes: DataFrame, a_edges: DataFrame, b_edges: DataFrame) -> DataFrame:
    """(what, n): how many nodes and edges changed in which way."""
    n = diff_nodes(a_nodes, b_nodes).groupBy(F.concat_ws("_", "status", F.lit("nodes")).alias("what")).agg(F.count("*").alias("n"))
    e = diff_edges(a_edges, b_edges).groupBy(F.concat_ws("_", "status", F.lit("edges")).alias("what")).agg(F.count("*").alias("n"))
    return n.unionByName(e).unionByName(changed_workflow(a_edges, b_edges).agg(F.lit("changed_workflow").alias("what"), F.count("*").alias("n")))


def labelled_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node_id, status) of all nodes of both versions, for a view that shows both; unchanged ones too."""
    return a.select("node_id").unionByName(b.select("node_id")).distinct().join(diff_nodes(a, b), "node_id", "left").select("node_id", F.coalesce("status", F.lit("unchanged")).alias("status"))
