"""The graph as an interface serves it: pages with their edges, summaries, neighbourhoods, SQL over its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analytics

# Names of the choice that leaves nothing out.
EVERY_DOCUMENT, EVERY_TYPE = "All Documents", "All"


@dataclass
class Page:
    nodes: DataFrame
    edges: DataFrame
    #: One row: node_count, edge_count, total_nodes, total_edges, truncated.
    about: DataFrame


def _chosen(value: str | None, every: str) -> str | None:
    value = (value or "").strip()
    return None if value in ("", every) else value


def page(nodes: DataFrame, edges: DataFrame, doc: str | None = None, kind: str | None = None, relation: str | None = None, limit: int = 300, skip: int = 0) -> Page:
    """Nodes of a document (doc_id or source) and type (whatever the case) by id, and the edges between them of a relation, with edge_id.

    ``truncated`` tells that the page is full. Blank choices and "All Documents" and "All" leave nothing out.
    """
    if not 1 <= limit <= 2000 or skip < 0:
        raise ValueError("limit must be between 1 and 2000, skip not negative")
    n, doc, kind, relation = nodes, _chosen(doc, EVERY_DOCUMENT), _chosen(kind, EVERY_TYPE), _chosen(relation, EVERY_TYPE)
    if doc:
        n = n.filter((F.col("doc_id") == doc) | (F.col("source") == doc) if "doc_id" in n.columns else F.col("source") == doc)
    if kind:
        n = n.filter(F.lower("node_type") == kind.lower())
    n = n.filter("trim(node_id) != ''").orderBy("node_id").offset(skip).limit(limit)
    e = analytics.induced(edges.filter(F.col("rel_type") == relation) if relation else edges, n)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    about = count(n, "node_count").crossJoin(count(e, "edge_count")).crossJoin(count(nodes, "total_nodes")).crossJoin(count(edges, "total_edges"))  # one row each
    return Page(n, analytics.edge_ids(e), about.withColumn("truncated", F.col("node_count") >= limit))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): counts of nodes and edges, by type, and of nodes by source document."""
    rows = lambda df, what, name: df.groupBy(F.lit(what).alias("what"), F.coalesce(name, F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n"))
    total = lambda df, what: df.agg(F.lit("total").alias("what"), F.lit(what).alias("name"), F.count("*").alias("n"))
    out = total(nodes, "nodes").unionByName(total(edges, "edges")).unionByName(rows(nodes, "node type", "node_type")).unionByName(rows(edges, "relation", "rel_type"))
    return out.unionByName(rows(nodes, "source", "source")) if "source" in nodes.columns else out


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "all") -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` (1 to 3) of the seeds, with their depth, and the edges between them."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be between 1 and 3")
    near = analytics.neighbours(edges, seeds, depth, direction)
    return nodes.join(near, "node_id"), analytics.induced(edges, near)


def sql(spark: SparkSession, text: str, nodes: DataFrame, edges: DataFrame, **values) -> DataFrame:
    """The result of a SQL text over {nodes} and {edges}; other names in braces are parameters."""
    return spark.sql(text, nodes=nodes, edges=edges, **values)


def resolved(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ends among the nodes, the others)."""
    ids = nodes.select("node_id").distinct()
    good = analytics.induced(edges, ids)
    return good, edges.join(good.select("src_id", "dst_id", "rel_type").distinct(), ["src_id", "dst_id", "rel_type"], "left_anti").select(*edges.columns)
