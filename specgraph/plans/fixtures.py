"""Graphs, items and documents projected from the driver's tables.

The projections are plain SQL that Spark and DuckDB read alike; what is tested are the operators on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # A graph of customers, orders and goods.
    "g_nodes": """
SELECT concat('region_', r_regionkey) AS node_id, 'Location' AS node_type, r_name AS name, CAST(NULL AS INT) AS seq FROM region
UNION ALL SELECT concat('nation_', n_nationkey), 'Country', n_name, CAST(NULL AS INT) FROM nation
UNION ALL SELECT concat('customer_', c_custkey), 'Actor', c_name, CAST(NULL AS INT) FROM customer
UNION ALL SELECT concat('supplier_', s_suppkey), 'SystemComponent', s_name, CAST(NULL AS INT) FROM supplier
UNION ALL SELECT concat('part_', p_partkey), 'DataObject', p_name, CAST(NULL AS INT) FROM part
UNION ALL SELECT concat('order_', o_orderkey), 'Action', concat('Order ', o_orderkey), CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) FROM orders""",
    "g_edges": """
SELECT concat('nation_', n_nationkey) AS src_id, concat('region_', n_regionkey) AS dst_id, 'PART_OF' AS rel_type FROM nation
UNION ALL SELECT concat('customer_', c_custkey), concat('nation_', c_nationkey), 'ASSOCIATED_WITH' FROM customer
UNION ALL SELECT concat('supplier_', s_suppkey), concat('nation_', s_nationkey), 'ASSOCIATED_WITH' FROM supplier
UNION ALL SELECT concat('customer_', o_custkey), concat('order_', o_orderkey), 'PERFORMS' FROM orders
UNION ALL SELECT src, dst, 'LEADS_TO' FROM (SELECT concat('order_', o_orderkey) AS src, concat('order_', lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS dst, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS has FROM orders) n WHERE has IS NOT NULL
UNION ALL SELECT DISTINCT concat('order_', l_orderkey), concat('part_', l_partkey), 'USES' FROM lineitem
UNION ALL SELECT DISTINCT concat('supplier_', l_suppkey), concat('part_', l_partkey), 'PRODUCES' FROM lineitem""",
    # A raw extraction: repeated under other spellings, types and directions.
    "raw_nodes": """
SELECT concat('Cust-', c_custkey) AS node_id, 'Actor' AS node_type, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS description, concat('REQ-', c_custkey % 50) AS source, c_custkey * 10 AS ord FROM customer
UNION ALL SELECT concat('cust ', c_custkey), 'Requirement', c_name, NULL, concat('REQ-', c_custkey % 50), c_custkey * 10 + 1 FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT upper(concat('cust_', c_custkey)), 'DataObject', c_name, 'data', concat('REQ-', c_custkey % 50), c_custkey * 10 - 5 FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT concat('part_', p_partkey), CASE WHEN p_size % 4 = 0 THEN 'Widget' WHEN p_size % 4 = 1 THEN 'Attribute' ELSE 'State' END, p_name, p_type, concat('REQ-', p_partkey % 60), p_partkey * 10 + 1000000000 FROM part
UNION ALL SELECT concat('PART-', p_partkey), CASE WHEN p_size % 3 = 0 THEN 'Event' ELSE 'Feature' END, p_name, p_type, concat('REQ-', p_partkey % 60), p_partkey * 10 + 1000000001 FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT concat('supp ', s_suppkey), 'Service', s_name, NULL, 'REQ-1', s_suppkey + 3000000000 FROM supplier""",
    # Its edges, from every row of lineitem, with spelling and direction varied by columns.
    "raw_edges": """
SELECT CASE WHEN l_linenumber % 3 = 0 THEN concat('PART_', l_partkey) ELSE concat('Supp-', l_suppkey) END AS src_id, CASE WHEN l_linenumber % 3 = 0 THEN concat('supp_', l_suppkey) ELSE concat('part ', l_partkey) END AS dst_id, CASE l_orderkey % 4 WHEN 0 THEN 'uses data' WHEN 1 THEN 'PRODUCES' WHEN 2 THEN 'part-of' ELSE 'custom: link' END AS rel_type, CASE WHEN l_linenumber % 3 = 0 THEN 'REQ-1' ELSE concat('REQ-', l_partkey % 60) END AS source, l_orderkey * 10 + l_linenumber AS ord FROM lineitem
UNION ALL SELECT concat('part_', p_partkey), concat('cust_', p_partkey % 1700), CASE WHEN p_partkey % 2 = 0 THEN 'PRODUCES' ELSE 'AUTHENTICATES' END, 'REQ-2', p_partkey + 9000000000 FROM part
UNION ALL SELECT concat('cust_', p_partkey % 1700), concat('part_', p_partkey), CASE WHEN p_partkey % 2 = 0 THEN 'DISPLAYS' ELSE 'AND' END, 'REQ-3', p_partkey + 9500000000 FROM part""",
    # Items that mention each other.
    "items_v": """
SELECT concat('FR-', lpad(CAST(l_orderkey AS VARCHAR(20)), 6, '0')) AS item_id, 'FR' AS family, concat('The system shall ship ', array_to_string(array_sort(collect), ', '), '.') AS content, l_orderkey AS ord FROM (SELECT l_orderkey, array_agg(DISTINCT concat('BR-', lpad(CAST(l_partkey AS VARCHAR(20)), 6, '0'))) AS collect FROM lineitem GROUP BY l_orderkey) o
UNION ALL SELECT concat('BR-', lpad(CAST(p_partkey AS VARCHAR(20)), 6, '0')), 'BR', concat('Part ', p_name, ' of ', p_brand), p_partkey + 1000000000 FROM part WHERE p_size <= 40""",
    # Two versions of a graph.
    "ver_a_nodes": "SELECT concat('part_', p_partkey) AS node_id, CASE WHEN p_size > 25 THEN 'State' ELSE 'Action' END AS node_type, p_type AS description, p_brand AS alias FROM part WHERE p_partkey % 7 <> 0",
    "ver_b_nodes": "SELECT concat('part_', p_partkey) AS node_id, CASE WHEN p_size > 27 THEN 'State' ELSE 'Action' END AS node_type, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS description, p_brand AS alias FROM part WHERE p_partkey % 5 <> 0",
    "ver_a_edges": "SELECT DISTINCT concat('supplier_', l_suppkey) AS src_id, concat('part_', l_partkey) AS dst_id, 'PRODUCES' AS rel_type FROM lineitem WHERE l_orderkey % 3 <> 0",
    "ver_b_edges": "SELECT DISTINCT concat('supplier_', l_suppkey) AS src_id, concat('part_', l_partkey) AS dst_id, 'PRODUCES' AS rel_type FROM lineitem WHERE l_orderkey % 5 <> 0",
    # Old and new vectors; test cases of conversations.
    "vec_old": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings WHERE vec_id % 2 = 0",
    "vec_new": "SELECT vec_id AS id, embedding AS vector, label FROM embeddings WHERE vec_id % 2 = 1",
    # Short texts of every kind that extraction tells apart.
    "notes": """
SELECT CAST(o_orderkey AS BIGINT) AS note_id, CASE CAST(o_orderkey % 13 AS INT) WHEN 0 THEN concat('Page ', o_custkey, ' of ', o_orderkey) WHEN 1 THEN 'Version  History' WHEN 2 THEN 'Version 1.2 reviewed by somebody, author unknown' WHEN 3 THEN concat('1) Open the order ', o_orderkey, ' and look at the total price')
WHEN 4 THEN concat('The customer shall submit order ', o_orderkey, ' before the end') WHEN 5 THEN 'Glossary of terms: first, the order, then the part of it' WHEN 6 THEN concat('Forvis Mazars ', o_custkey) WHEN 7 THEN concat('change description of the last version ', o_orderkey)
WHEN 8 THEN concat('order ', o_orderkey, ' -> warehouse -> carrier -> customer, whoever that is') WHEN 9 THEN concat('  ', o_orderpriority, '  ') WHEN 10 THEN concat('Order with the version ', o_orderkey, ' of priority ', o_orderpriority, ' to be shipped') WHEN 11 THEN NULL ELSE concat('Priority ', o_orderpriority, ' and availability of what order ', o_orderkey, ' needs next') END AS text FROM orders""",
    # Branching flows: an order's lines in a row, with ways round every second one; some begin at an actor, some in a feature.
    "fx_steps": """
SELECT o, l, row_number() OVER (PARTITION BY o ORDER BY l) AS k, concat('s_', o, '_', l, CASE WHEN l % 4 = 0 THEN '_error' ELSE '' END) AS node_id, CASE WHEN o % 5 = 0 AND l % 7 = 1 THEN 'Feature' WHEN l % 3 = 0 THEN 'State' ELSE 'Action' END AS node_type, concat('Step ', l, ' of ', o) AS name FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS INT) AS l FROM lineitem) x""",
    "ev_edges": "SELECT DISTINCT event_type AS src_id, nxt AS dst_id, 'LEADS_TO' AS rel_type FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) e WHERE nxt IS NOT NULL",
}


def cte(*names: str) -> str:
    """WITH clause for the named projections, in DuckDB's dialect."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)


#: Nodes and edges of the branching flows, over fx_steps.
FX_NODES = "SELECT node_id, node_type, name, CAST(l AS INT) AS seq, concat('REQ-', o) AS source FROM fx_steps UNION ALL SELECT DISTINCT concat('actor_', o), 'Actor', concat('Buyer ', o), CAST(NULL AS INT), concat('REQ-', o) FROM fx_steps WHERE o % 2 = 0"
FX_EDGES = """SELECT a.node_id AS src_id, b.node_id AS dst_id, CASE WHEN b.k - a.k = 1 THEN 'LEADS_TO' ELSE 'TRIGGERS' END AS rel_type FROM fx_steps a JOIN fx_steps b ON a.o = b.o AND (b.k = a.k + 1 OR (b.k = a.k + 2 AND a.l % 2 = 1))
UNION ALL SELECT concat('actor_', o), node_id, 'PERFORMS' FROM fx_steps WHERE k = 1 AND o % 2 = 0"""


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the branching flows."""
    load(spark, sf_dir, "fx_steps").createOrReplaceTempView("fx_steps")
    return spark.sql(FX_NODES), spark.sql(FX_EDGES)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a projection of them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("array_to_string", "array_join")
    used = [t for t in TABLES if f"FROM {t}" in text]
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"base_{t}")
        text = text.replace(f"FROM {t}", f"FROM base_{t}")
    return spark.sql(text)
