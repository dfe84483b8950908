"""Structure of a graph: counts, degrees, components, neighbourhoods, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O
from ..sources.shared import cut, drop


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.coalesce(kind, F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): ends of edges between two different known nodes."""
    ids = nodes.select("node_id").distinct()
    e = edges.filter("src_id != dst_id").select("src_id", "dst_id").join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    ends = e.groupBy(F.col("src_id").alias("node_id")).count().unionByName(e.groupBy(F.col("dst_id").alias("node_id")).count())
    d = ends.groupBy("node_id").agg(F.sum("count").alias("degree"))
    return ids.join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hubs(degree: DataFrame, ratio: float = 0.15) -> DataFrame:
    """(node_id, degree, share) of nodes with at least ``ratio`` of all edge ends."""
    total = degree.agg(F.sum("degree").alias("total"))
    return degree.crossJoin(F.broadcast(total)).withColumn("share", F.col("degree") / F.col("total")).filter(F.col("share") >= ratio).drop("total")  # one row


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node_id, component): the smallest id reachable without regard to direction.

    Large-star and small-star steps in turn: every node's larger neighbours are linked to the smallest that it knows, then what remains smaller likewise, until
    the edges are stars around the smallest nodes. A step has as many edges as the one before at most, and a node's minimum is summed up before the shuffle.
    """
    ids = nodes.select("node_id").distinct()
    known = induced(edges.select("src_id", "dst_id"), ids)
    e = cut(known.select(F.greatest("src_id", "dst_id").alias("a"), F.least("src_id", "dst_id").alias("b")).filter("a != b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, e = e, cut(small, "links")
        drop(last)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    return ids.join(e.select(F.col("a").alias("node_id"), F.col("b").alias("component")), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 1, direction: str = "all") -> DataFrame:
    """(node_id, depth) of nodes within ``hops`` of the seeds (column node_id), which are at depth 0; direction: out, in or all."""
    e = edges.select("src_id", "dst_id")
    if direction == "in":
        e = e.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    elif direction == "all":
        e = e.unionByName(e.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    seen = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        step = e.join(front.select(F.col("node_id").alias("src_id")), "src_id").select(F.col("dst_id").alias("node_id")).distinct()
        front = step.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(k))
        if hops > 1:  # else each hop would find those before it anew
            front = cut(front, "hop")
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (column node_id)."""
    i = ids.select("node_id").distinct()
    return edges.join(i.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(i.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def flow_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, pos): flow relations between nodes that can be part of a flow; pos orders successors by sequence (nulls last), then id."""
    n = nodes.filter(~F.lower(F.coalesce("node_type", F.lit(""))).isin(*O.FLOW_EXCLUDED_TYPES)).select("node_id", "seq")
    e = edges.filter(F.col("rel_type").isin(*O.FLOW_RELATIONS)).select("src_id", "dst_id", "rel_type")
    e = e.join(n.select(F.col("node_id").alias("src_id")), "src_id", "left_semi").join(n.select(F.col("node_id").alias("dst_id"), "seq"), "dst_id")
    return e.withColumn("pos", F.row_number().over(W.partitionBy("src_id").orderBy(F.col("seq").asc_nulls_last(), "dst_id", "rel_type"))).select("src_id", "dst_id", "pos")


def entries(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """(node_id, tier): where a flow begins. 1: tagged nodes; else 2: actors; else 3: nodes that nothing leads to; each with an outgoing edge. Else 4: the node with most outgoing edges."""
    out = flow.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("outdeg"))
    into = flow.select(F.col("dst_id").alias("node_id"), F.lit(True).alias("has_in")).distinct()
    n = nodes.select("node_id", "node_type", *(["is_flow_entry"] if "is_flow_entry" in nodes.columns else [])).join(out, "node_id").join(into, "node_id", "left")
    tagged = F.coalesce(F.col("is_flow_entry"), F.lit(False)) if "is_flow_entry" in nodes.columns else F.lit(False)
    tier = F.when(tagged, 1).when(F.col("node_type") == "Actor", 2).when(F.col("has_in").isNull(), 3).otherwise(4)
    t = n.withColumn("tier", tier)
    best = t.agg(F.min("tier").alias("best"), F.max_by(F.struct("outdeg", "node_id"), F.struct("outdeg", "node_id")).alias("top"))
    keep = (F.col("tier") == F.col("best")) & ((F.col("best") < 4) | (F.col("node_id") == F.col("top.node_id")))
    return t.crossJoin(F.broadcast(best)).filter(keep).select("node_id", "tier")  # one row


def reach(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(src_id, dst_id, depth): nodes reachable in 1 to ``hops`` steps, with the fewest."""
    e = cut(edges.select("src_id", "dst_id").distinct(), "reach")
    seen = e.withColumn("depth", F.lit(1))
    front = e
    for k in range(2, hops + 1):
        step = front.join(e.select(F.col("src_id").alias("dst_id"), F.col("dst_id").alias("next")), "dst_id").select("src_id", F.col("next").alias("dst_id")).distinct()
        front = cut(step.join(seen, ["src_id", "dst_id"], "left_anti"), "reach")
        seen = seen.unionByName(front.withColumn("depth", F.lit(k)))
    return seen


def siblings(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(parent, node_type, members): groups of at least ``least`` children of one type without outgoing edges."""
    leaf = nodes.join(edges.select(F.col("src_id").alias("node_id")).distinct(), "node_id", "left_anti")
    pairs = edges.select(F.col("src_id").alias("parent"), F.col("dst_id").alias("node_id")).distinct().join(leaf.select("node_id", "node_type"), "node_id")
    return pairs.groupBy("parent", "node_type").agg(F.array_sort(F.collect_set("node_id")).alias("members")).filter(F.size("members") >= least)


def top_types(nodes: DataFrame, group: str, k: int = 3) -> DataFrame:
    """(group, size, types): size of each group and its ``k`` most frequent node types, ties by name."""
    c = nodes.groupBy(group, "node_type").agg(F.count("*").alias("n"))
    w = W.partitionBy(group)
    r = c.withColumn("size", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("n").desc(), "node_type")))
    top = F.transform(F.array_sort(F.collect_list(F.struct("rn", "node_type"))), lambda x: x["node_type"])
    return r.filter(F.col("rn") <= k).groupBy(group).agg(F.max("size").alias("size"), top.alias("types"))


def page(nodes: DataFrame, limit: int = 300, skip: int = 0, kind: str | None = None) -> DataFrame:
    """One page of nodes by id; limit 1 to 2000, skip not negative."""
    if not 1 <= limit <= 2000 or skip < 0:
        raise ValueError("limit must be between 1 and 2000, skip not negative")
    n = nodes.filter(F.lower("node_type") == kind.lower()) if kind else nodes
    return n.orderBy("node_id").offset(skip).limit(limit)


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with edge_id: signature and ordinal among equal ones."""
    w = W.partitionBy("src_id", "rel_type", "dst_id").orderBy("src_id")
    return edges.withColumn("edge_id", F.format_string("edge:%s-%s->%s:%d", "src_id", "rel_type", "dst_id", F.row_number().over(w) - 1))
