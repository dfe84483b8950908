"""Queries: structure, neighbourhoods, flow and roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..operators import analytics as A
from ..operators import roles as R
from .fixtures import cte, load


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _g(s, d):
    return load(s, d, "g_nodes"), load(s, d, "g_edges")


def _customers(s, d, which="c_custkey IS NOT NULL"):
    return load(s, d, "customer").filter(which).select(F.concat(F.lit("customer_"), "c_custkey").alias("node_id"))


def _roles(s, d):
    n, e = _g(s, d)
    r = R.classify_nodes(n)
    return r, R.classify_edges(e, r)


_ev = "SELECT DISTINCT src_id AS node_id FROM ev_edges UNION SELECT dst_id FROM ev_edges"


def _order_components(s, d):
    n, e = _g(s, d)
    return A.components(n.filter("node_type IN ('Actor', 'Action')"), e.filter("rel_type IN ('PERFORMS', 'LEADS_TO')"))


QUERIES = {
    "agg01_node_types": lambda s, d: A.type_counts(load(s, d, "g_nodes"), "node_type"),
    "agg01_relation_types": lambda s, d: A.type_counts(load(s, d, "g_edges"), "rel_type"),
    "src16_node_count": lambda s, d: load(s, d, "g_nodes").agg(F.count("*").alias("n")),
    "agg04_degrees": lambda s, d: A.degrees(*_g(s, d)),
    "agg04_isolated": lambda s, d: A.degrees(*_g(s, d)).filter("degree = 0").select("node_id"),
    "agg04_hubs": lambda s, d: A.hubs(A.degrees(*_g(s, d)), 0.0005),
    "gr01_components": lambda s, d: _order_components(s, d),
    "gr01_component_summary": lambda s, d: _order_components(s, d).groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"), F.sum("count").alias("nodes")),
    "jn02_induced": lambda s, d: A.induced(load(s, d, "g_edges"), load(s, d, "g_nodes").filter("node_type IN ('Country', 'Location', 'SystemComponent')")),
    "jn03_expand": lambda s, d: A.neighbours(load(s, d, "g_edges"), _customers(s, d)).filter("depth > 0"),
    "jn04_khop": lambda s, d: A.neighbours(load(s, d, "g_edges"), _customers(s, d), 3, "out"),
    "jn04_khop_in": lambda s, d: A.neighbours(load(s, d, "g_edges").filter("rel_type <> 'USES'"), load(s, d, "g_nodes").filter("node_type = 'Location'"), 2, "in"),
    "gr02_flow_edges": lambda s, d: A.flow_edges(*_g(s, d)),
    "gr03_entries": lambda s, d: A.entries(load(s, d, "g_nodes"), A.flow_edges(*_g(s, d))),
    "gr09_reach": lambda s, d: A.reach(load(s, d, "ev_edges")),
    "gr06_cyclic_nodes": lambda s, d: A.reach(load(s, d, "ev_edges"), 5).filter("src_id = dst_id").select("src_id"),
    "jn25_siblings": lambda s, d: A.siblings(load(s, d, "g_nodes").filter("node_type = 'DataObject'"), load(s, d, "g_edges")).select("parent", "node_type", F.concat_ws(",", "members").alias("members")),
    "agg07_top06_top_types": lambda s, d: A.top_types(load(s, d, "g_nodes").withColumn("community", F.pmod(F.length("name"), F.lit(7))), "community").select("community", "size", F.concat_ws(",", "types").alias("types")),
    "top01_page": lambda s, d: A.page(load(s, d, "g_nodes"), 300, 600, "action"),
    "prj15_edge_ids": lambda s, d: A.edge_ids(load(s, d, "g_edges").unionByName(load(s, d, "lineitem").select(F.concat(F.lit("supplier_"), "l_suppkey").alias("src_id"), F.concat(F.lit("part_"), "l_partkey").alias("dst_id"), F.lit("PRODUCES").alias("rel_type")))),
    "prj10_node_roles": lambda s, d: _roles(s, d)[0].select("node_id", "role", "testable", "confidence", "decided_by"),
    "prj11_jn10_edge_roles": lambda s, d: _roles(s, d)[1].select("src_id", "dst_id", "rel_type", "role"),
    "prj09_testable": lambda s, d: _roles(s, d)[0].filter("testable").select("node_id"),
    "prj12_universe": lambda s, d: R.universe(*_roles(s, d)).groupBy("list").agg(F.count("*").alias("n"), F.min("id").alias("lowest"), F.max("id").alias("highest")),
}

_N, _E, _G = cte("g_nodes"), cte("g_edges"), cte("g_nodes", "g_edges")
_DEG = """deg AS (SELECT node_id, count(x) AS degree FROM g_nodes LEFT JOIN (SELECT src_id AS x FROM g_edges WHERE src_id <> dst_id UNION ALL SELECT dst_id FROM g_edges WHERE src_id <> dst_id) e ON e.x = node_id GROUP BY node_id)"""
_FLOW = f"""fl AS (SELECT src_id, dst_id, row_number() OVER (PARTITION BY src_id ORDER BY seq ASC NULLS LAST, dst_id, rel_type) AS pos FROM g_edges JOIN g_nodes ON node_id = dst_id WHERE rel_type IN ({_list(O.FLOW_RELATIONS)}))"""
_KHOP = """r AS (SELECT node_id, 0 AS depth FROM seeds UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node_id WHERE r.depth < {k})"""
_NROLE = "CASE " + " ".join(f"WHEN node_type IN ({_list(k)}) THEN '{r}'" for r, k in O.NODE_ROLES.items() if r != "artifact") + " " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(w)}') THEN '{r}'" for r, w in O.NAME_ROLES) + " ELSE 'other' END"
_NBY = "CASE WHEN node_type IN (" + ", ".join(_list(k) for k in O.NODE_ROLES.values()) + ") THEN 'type' WHEN " + " OR ".join(f"regexp_matches(lower(name), '{'|'.join(w)}')" for _, w in O.NAME_ROLES) + " THEN 'name' ELSE 'fallback' END"
_ROLES = f"""nr AS (SELECT node_id, {_NROLE} AS role, {_NBY} AS decided_by FROM g_nodes),
er AS (SELECT src_id, dst_id, rel_type, CASE WHEN rel_type IN ({_list(O.EDGE_ROLES['workflow_transition'])}) AND (a.role = 'metadata' OR b.role = 'metadata') THEN 'attribute' {" ".join(f"WHEN rel_type IN ({_list(k)}) THEN '{r}'" for r, k in O.EDGE_ROLES.items())} ELSE 'other' END AS role FROM g_edges JOIN nr a ON a.node_id = src_id JOIN nr b ON b.node_id = dst_id)"""
_CC = """p AS (SELECT src_id AS a, dst_id AS b FROM g_edges WHERE rel_type IN ('PERFORMS', 'LEADS_TO')), c0 AS (SELECT node_id, node_id AS component FROM g_nodes WHERE node_type IN ('Actor', 'Action')),
cc AS (SELECT node_id, CASE WHEN node_id LIKE 'customer%' THEN node_id ELSE (SELECT min(a) FROM p WHERE b = node_id AND a LIKE 'customer%') END AS own FROM c0), co AS (SELECT node_id, min(node_id) OVER (PARTITION BY coalesce(own, node_id)) AS component FROM cc)"""
SQL = {
    "agg01_node_types": f"{_N} SELECT node_type AS type, count(*) AS n FROM g_nodes GROUP BY 1",
    "agg01_relation_types": f"{_E} SELECT rel_type AS type, count(*) AS n FROM g_edges GROUP BY 1",
    "src16_node_count": f"{_N} SELECT count(*) AS n FROM g_nodes",
    "agg04_degrees": f"{_G}, {_DEG} SELECT * FROM deg",
    "agg04_isolated": f"{_G}, {_DEG} SELECT node_id FROM deg WHERE degree = 0",
    "agg04_hubs": f"{_G}, {_DEG} SELECT node_id, degree, degree / (SELECT sum(degree) FROM deg) AS share FROM deg WHERE degree / (SELECT sum(degree) FROM deg) >= 0.0005",
    "gr01_components": f"{_G}, {_CC} SELECT * FROM co",
    "gr01_component_summary": f"{_G}, {_CC} SELECT count(*) AS components, max(n) AS largest, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT component, count(*) AS n FROM co GROUP BY 1)",
    "jn02_induced": f"{_G} SELECT e.* FROM g_edges e WHERE src_id IN (SELECT node_id FROM g_nodes WHERE node_type IN ('Country', 'Location', 'SystemComponent')) AND dst_id IN (SELECT node_id FROM g_nodes WHERE node_type IN ('Country', 'Location', 'SystemComponent'))",
    "jn03_expand": f"{_E}, seeds AS (SELECT concat('customer_', c_custkey) AS node_id FROM customer), e AS (SELECT src_id AS a, dst_id AS b FROM g_edges UNION ALL SELECT dst_id, src_id FROM g_edges) SELECT DISTINCT b AS node_id, 1 AS depth FROM e WHERE a IN (FROM seeds) AND b NOT IN (FROM seeds)",
    "jn04_khop": f"{_E}, seeds AS (SELECT concat('customer_', c_custkey) AS node_id FROM customer), e AS (SELECT src_id AS a, dst_id AS b FROM g_edges), {_KHOP.format(k=3)} SELECT node_id, min(depth) AS depth FROM r GROUP BY node_id",
    "jn04_khop_in": f"{_G}, seeds AS (SELECT node_id FROM g_nodes WHERE node_type = 'Location'), e AS (SELECT dst_id AS a, src_id AS b FROM g_edges WHERE rel_type <> 'USES'), {_KHOP.format(k=2)} SELECT node_id, min(depth) AS depth FROM r GROUP BY node_id",
    "gr02_flow_edges": f"{_G}, {_FLOW} SELECT * FROM fl",
    "gr03_entries": f"{_G}, {_FLOW} SELECT DISTINCT src_id AS node_id, 2 AS tier FROM fl JOIN g_nodes ON node_id = src_id WHERE node_type = 'Actor'",
    "gr09_reach": f"{cte('ev_edges')}, r AS (SELECT src_id, dst_id, 1 AS depth FROM ev_edges UNION SELECT r.src_id, e.dst_id, depth + 1 FROM r JOIN ev_edges e ON e.src_id = r.dst_id WHERE depth < 4) SELECT src_id, dst_id, min(depth) AS depth FROM r GROUP BY 1, 2",
    "gr06_cyclic_nodes": f"{cte('ev_edges')}, r AS (SELECT src_id, dst_id FROM ev_edges UNION SELECT r.src_id, e.dst_id FROM r JOIN ev_edges e ON e.src_id = r.dst_id) SELECT DISTINCT src_id FROM r WHERE src_id = dst_id",
    "jn25_siblings": f"{_G} SELECT parent, node_type, string_agg(node_id, ',' ORDER BY node_id) AS members FROM (SELECT DISTINCT src_id AS parent, node_type, node_id FROM g_edges JOIN g_nodes ON node_id = dst_id WHERE node_type = 'DataObject' AND node_id NOT IN (SELECT src_id FROM g_edges)) t GROUP BY 1, 2 HAVING count(*) >= 3",
    "agg07_top06_top_types": f"{_N}, c AS (SELECT CAST(length(name) % 7 AS INT) AS community, node_type, count(*) AS n FROM g_nodes GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY n DESC, node_type) AS rn FROM c) SELECT community, CAST(max(size) AS BIGINT) AS size, string_agg(node_type, ',' ORDER BY rn) AS types FROM r WHERE rn <= 3 GROUP BY community",
    "top01_page": f"{_N} SELECT * FROM g_nodes WHERE lower(node_type) = 'action' ORDER BY node_id LIMIT 300 OFFSET 600",
    "prj15_edge_ids": f"{_E} SELECT *, 'edge:' || src_id || '-' || rel_type || '->' || dst_id || ':' || (row_number() OVER (PARTITION BY src_id, dst_id, rel_type) - 1) AS edge_id FROM (SELECT * FROM g_edges UNION ALL SELECT concat('supplier_', l_suppkey), concat('part_', l_partkey), 'PRODUCES' FROM lineitem) e",
    "prj10_node_roles": f"{_G}, {_ROLES} SELECT node_id, role, role IN ({_list(R.TESTABLE)}) AS testable, CASE decided_by WHEN 'type' THEN 0.95::DOUBLE WHEN 'name' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence, decided_by FROM nr",
    "prj11_jn10_edge_roles": f"{_G}, {_ROLES} SELECT * FROM er",
    "prj09_testable": f"{_G}, {_ROLES} SELECT node_id FROM nr WHERE role IN ({_list(R.TESTABLE)})",
    "prj12_universe": f"""{_G}, {_ROLES}, u AS (SELECT CASE WHEN role IN ('workflow_step', 'workflow_state') THEN 'workflow' WHEN role = 'actor' THEN 'actors' WHEN role = 'input' THEN 'inputs' WHEN role = 'business_rule' THEN 'business_rules' WHEN role = 'requirement' THEN 'requirements' END AS list, node_id AS id FROM nr
UNION ALL SELECT 'transitions', src_id || '|' || rel_type || '|' || dst_id FROM er WHERE role = 'workflow_transition' UNION ALL SELECT 'edges', src_id || '|' || rel_type || '|' || dst_id FROM er WHERE role <> 'metadata') SELECT list, count(*) AS n, min(id) AS lowest, max(id) AS highest FROM u WHERE list IS NOT NULL GROUP BY list""",
}
