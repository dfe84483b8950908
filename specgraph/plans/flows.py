"""Queries: control flow, communities, streaming windows over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as L
from ..streaming import incremental as I
from .fixtures import load


def _walks(s, d):
    """Chains of each customer's orders, with a way back at every fifth."""
    n = load(s, d, "g_nodes").filter("node_type = 'Action'").select("node_id", "seq")
    o = load(s, d, "orders").select(F.concat(F.lit("order_"), "o_orderkey").alias("src_id"), F.col("o_custkey").alias("flow"))
    e = load(s, d, "g_edges").filter("rel_type = 'LEADS_TO'").join(o, "src_id").join(n.withColumnRenamed("node_id", "dst_id"), "dst_id")
    back = e.filter("seq % 5 = 0").select("flow", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit(2).alias("pos"))
    return e.select("flow", "src_id", "dst_id", F.lit(1).alias("pos")).unionByName(back)


QUERIES = {
    "gr05_depth_first": lambda s, d: L.depth_first(_walks(s, d)),
    "gr05_edge_classes": lambda s, d: L.edge_classes(_walks(s, d)).groupBy("class").agg(F.count("*").alias("n")),
    "gr04_dominators": lambda s, d: L.dominators(_walks(s, d)).groupBy("flow", "node_id").agg(F.count("*").alias("n")),
    "gr06_loops": lambda s, d: L.loops(_walks(s, d)),
    "gr07_walks": lambda s, d: L.walks(_walks(s, d)),
    "gr07_branches_merges": lambda s, d: L.branches_and_merges(_walks(s, d)),
    "gr08_communities": lambda s, d: L.communities(_walks(s, d)),
    "win17_level_groups": lambda s, d: L.level_groups(load(s, d, "embeddings").select(F.col("label").alias("community"))),
    "ext_windowed_counts": lambda s, d: I.windowed_counts(load(s, d, "events"), "1 day"),
}
_W = """WITH o AS (SELECT o_custkey AS flow, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)"""
SQL = {
    "gr05_edge_classes": f"{_W} SELECT 'tree' AS class, count(*) AS n FROM o WHERE seq > 1 UNION ALL SELECT 'back', count(*) FROM o WHERE seq > 1 AND seq % 5 = 0",
    "gr04_dominators": f"{_W} SELECT flow, concat('order_', k) AS node_id, seq AS n FROM o WHERE c > 1",
    "gr06_loops": f"{_W} SELECT a.flow, concat('order_', a.k) AS header, concat('order_', b.k) AS node_id FROM o a JOIN o b ON a.flow = b.flow AND b.seq IN (a.seq, a.seq + 1) WHERE (a.seq + 1) % 5 = 0 AND a.seq < a.c",
    "gr07_walks": f"{_W} SELECT a.flow, concat('order_', e.k) AS entry, concat('order_', a.k) AS node_id, CAST(a.seq - 1 AS INT) AS step FROM o a JOIN o e ON e.flow = a.flow AND e.seq = 1 WHERE a.c > 1",
    "gr07_branches_merges": f"{_W} SELECT flow, concat('order_', k) AS node_id, 'branch' AS kind, 2 AS n FROM o WHERE seq % 5 = 0 AND seq > 1 AND seq < c UNION ALL SELECT flow, concat('order_', k), 'merge', 2 FROM o WHERE (seq + 1) % 5 = 0 AND seq < c AND seq > 1",
    "win17_level_groups": "WITH c AS (SELECT DISTINCT label AS community FROM embeddings), n AS (SELECT count(*) AS n FROM c) SELECT community, CAST(floor((row_number() OVER (ORDER BY community) - 1) / ceil(n / greatest(2, ceil(sqrt(n))))) AS INT) AS level_group FROM c, n",
    "ext_windowed_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
