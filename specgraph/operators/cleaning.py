"""Deduplication, validation and confidence of an extracted graph.

Nodes have node_id, node_type, description, source and ord, edges src_id, dst_id, rel_type, source and ord;
``ord`` is the order of extraction, in which the first of equals wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O
from ..functions.text import normalize_id, normalize_relation


def _priority(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in O.TYPE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One node per normalised id: the first of the highest type priority, with the number of times it was extracted."""
    n = nodes.withColumn("node_id", normalize_id(F.col("node_id")))
    w = W.partitionBy("node_id")
    ranked = n.withColumn("occ", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(_priority(F.col("node_type")).desc(), "ord")))
    return ranked.filter("_rn = 1").drop("_rn")


def type_conflicts(nodes: DataFrame) -> DataFrame:
    """(node_id, ord, kept_type, ignored_type): arrivals whose type differs from that of the node held so far."""
    n = nodes.select(normalize_id(F.col("node_id")).alias("node_id"), "ord", "node_type")
    before = W.partitionBy("node_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rank = F.struct(_priority(F.col("node_type")).alias("p"), (-F.col("ord")).alias("o"))
    held = F.max(F.struct(rank.alias("r"), F.col("node_type").alias("t"))).over(before)
    seen = n.withColumn("held", held).filter("held IS NOT NULL").withColumn("held", F.col("held.t")).filter("held != node_type")
    wins = _priority(F.col("node_type")) > _priority(F.col("held"))
    return seen.select("node_id", "ord", F.when(wins, F.col("node_type")).otherwise(F.col("held")).alias("kept_type"), F.when(wins, F.col("held")).otherwise(F.col("node_type")).alias("ignored_type"))


def _directed(edges: DataFrame) -> DataFrame:
    e = edges.withColumn("src_id", normalize_id(F.col("src_id"))).withColumn("dst_id", normalize_id(F.col("dst_id")))
    pair = [F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id"), F.col("rel_type")]
    first = F.first("src_id").over(W.partitionBy(*pair).orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    exact = W.partitionBy("src_id", "dst_id", "rel_type")
    return e.withColumn("_first", first).withColumn("occ", F.count("*").over(exact)).withColumn("_rn", F.row_number().over(exact.orderBy("ord")))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per triple; of two directions the one that came first."""
    return _directed(edges).filter("_rn = 1 AND src_id = _first").drop("_rn", "_first")


def direction_conflicts(edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, rel_type, ord): edges dropped because the reverse came first."""
    return _directed(edges).filter("src_id != _first").select("src_id", "dst_id", "rel_type", "ord")


def check_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``reasons``: why each is invalid (empty: valid)."""
    kind = F.regexp_replace(F.coalesce("node_type", F.lit("")), " ", "")
    return nodes.withColumn("reasons", F.array_compact(F.array(F.when(~kind.isin(*O.NODE_TYPES), F.concat(F.lit("unknown node type: "), F.coalesce("node_type", F.lit("")))))))


def check_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with normalised type and ``reasons``; ``nodes`` are the valid ones.

    Rules of direction are asked only where both ends exist. Two edges of one type between the same nodes
    in both directions contradict each other, and a self-loop itself, unless the type is symmetric.
    Repeated triples share their fate.
    """
    n = nodes.select("node_id", "node_type")
    e = edges.withColumn("rel_type", normalize_relation(F.col("rel_type")))
    e = e.join(n.select(F.col("node_id").alias("src_id"), F.col("node_type").alias("src_type"), F.lit(True).alias("has_src")), "src_id", "left")
    e = e.join(n.select(F.col("node_id").alias("dst_id"), F.col("node_type").alias("dst_type"), F.lit(True).alias("has_dst")), "dst_id", "left")
    both = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("has_src").isNull(), "source not found"),
        F.when(F.col("has_dst").isNull(), "target not found"),
        F.when(both & F.col("rel_type").isin(*O.ACTOR_TARGET_FORBIDDEN) & (F.col("dst_type") == "Actor"), "actor as target"),
        F.when(both & (F.col("rel_type") == "AUTHENTICATES") & ~F.coalesce(F.col("src_type"), F.lit("")).isin(*O.AUTHENTICATES_SOURCES), "source cannot authenticate"),
        F.when(both & (F.col("rel_type") == "SHOWS") & (F.col("src_type") == "Actor"), "actor as source"),
    ))
    e = e.withColumn("reasons", reasons).drop("src_type", "dst_type", "has_src", "has_dst")
    sound = e.filter((F.size("reasons") == 0) & ~F.col("rel_type").isin(*O.SYMMETRIC_RELATIONS))
    back = sound.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "rel_type", F.lit(True).alias("reciprocal")).distinct()
    e = e.join(back, ["src_id", "dst_id", "rel_type"], "left")
    wrong = F.col("reciprocal").isNotNull() & (F.size("reasons") == 0)
    return e.withColumn("reasons", F.when(wrong, F.array(F.lit("contradicts its reverse"))).otherwise(F.col("reasons"))).drop("reciprocal")


def validate(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """valid_nodes, review_nodes, valid_edges, review_edges: nothing is dropped."""
    n = check_nodes(nodes)
    good = n.filter(F.size("reasons") == 0)
    e = check_edges(edges, good)
    return {"valid_nodes": good.drop("reasons"), "review_nodes": n.filter(F.size("reasons") > 0), "valid_edges": e.filter(F.size("reasons") == 0).drop("reasons"), "review_edges": e.filter(F.size("reasons") > 0)}


def _occurrences(occ: Column) -> Column:
    c = O.CONFIDENCE
    return F.when(occ <= 1, 0.0).when(occ == 2, c["twice"]).otherwise(c["more"])


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score.cast("decimal(12,6)"), 2).cast("double")))


def score_nodes(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Deduplicated nodes with ``confidence``."""
    c = O.CONFIDENCE
    bad = conflicts.select("node_id", F.lit(True).alias("_bad")).distinct()
    s = F.lit(c["base"]) + _occurrences(F.col("occ")) + F.when(F.coalesce("description", F.lit("")) != "", c["description"]).otherwise(0.0) - F.when(F.col("_bad").isNotNull(), c["type_conflict"]).otherwise(0.0)
    return nodes.join(bad, "node_id", "left").withColumn("confidence", _bounded(s)).drop("_bad")


def score_edges(edges: DataFrame, scored: DataFrame, conflicts: DataFrame, linked: DataFrame) -> DataFrame:
    """Deduplicated edges with ``confidence``; ``linked`` has the sources (column source) that a rule-based link speaks for."""
    c = O.CONFIDENCE
    ends = scored.select("node_id", "confidence")
    e = edges.join(ends.select(F.col("node_id").alias("src_id"), F.col("confidence").alias("_a")), "src_id", "left").join(ends.select(F.col("node_id").alias("dst_id"), F.col("confidence").alias("_b")), "dst_id", "left")
    bad = conflicts.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "rel_type", F.lit(True).alias("_bad")).distinct()
    e = e.join(bad, ["src_id", "dst_id", "rel_type"], "left").join(linked.select("source", F.lit(True).alias("_linked")).distinct(), "source", "left")
    mean = (F.coalesce("_a", F.lit(c["base"])) + F.coalesce("_b", F.lit(c["base"]))) / 2
    s = F.lit(c["base"]) + _occurrences(F.col("occ")) + (mean - c["base"]) * c["endpoints"] - F.when(F.col("_bad").isNotNull(), c["direction_conflict"]).otherwise(0.0) + F.when(F.col("_linked").isNotNull(), c["linked"]).otherwise(0.0)
    return e.withColumn("confidence", _bounded(s)).drop("_a", "_b", "_bad", "_linked")


def confidence_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, means and how many are low, of nodes and edges."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"total_{name}"), F.count_if(F.col("confidence") < O.CONFIDENCE["low"]).alias(f"low_{name}"), F.round(F.avg(F.col("confidence").cast("decimal(9,4)")), 2).cast("double").alias(f"avg_{name}"))

    return of(nodes, "nodes").crossJoin(of(edges, "edges"))  # one row each
