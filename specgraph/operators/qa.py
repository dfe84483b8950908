"""Question answering without query generation: linked entities and their facts, then text, then what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from .retrieval import nearest


def entity_facts(nodes: DataFrame, edges: DataFrame, question: str, k: int = 8, least: float = 0.35) -> DataFrame:
    """(src_id, rel_type, dst_id, score) of edges at the nodes (node_id, vector) most similar to the question."""
    v = providers.hashed_embedding([question])[0]
    hit = nearest(nodes.withColumnRenamed("node_id", "id"), v, k, "cosine", least).select(F.col("id").alias("node_id"), "score")
    out = edges.join(F.broadcast(hit.withColumnRenamed("node_id", "src_id")), "src_id").select("src_id", "rel_type", "dst_id", "score")
    into = edges.join(F.broadcast(hit.withColumnRenamed("node_id", "dst_id")), "dst_id").select("src_id", "rel_type", "dst_id", "score")
    return out.unionByName(into).groupBy("src_id", "rel_type", "dst_id").agg(F.max("score").alias("score"))


def ask(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, question: str, answer=providers.unreachable) -> dict:
    """{tier, context, answer}: facts of linked entities, else the nearest chunks (id, vector, text); ``answer`` may phrase them."""
    facts = entity_facts(nodes, edges, question).orderBy(F.desc("score"), "src_id", "dst_id").limit(25).collect()
    tier, lines = "graph", [f"{r.src_id} {r.rel_type} {r.dst_id}" for r in facts]
    if not lines:
        near = nearest(chunks, providers.hashed_embedding([question])[0], 5).select("text").collect()
        tier, lines = ("text", [r.text for r in near]) if near else ("none", [])
    context = "\n".join(lines)
    return {"tier": tier, "context": context, "answer": answer([f"{question}\n{context}"])[0] or context}
