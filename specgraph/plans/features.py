"""Queries: features of branching flows, workflow walks, reports on structure and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import flow as L
from ..operators import reports as P
from ..operators import roles as R
from ..sources.shared import cut
from .fixtures import FX_EDGES, FX_NODES, cte, flows, load


def _found(s, d):
    n, e = flows(s, d)
    r, e = cut(R.classify_nodes(n), "flow-nodes"), cut(e, "flow-edges")
    n = r.select(*n.columns)
    return X.features(n, e, r, R.classify_edges(e, r)), n, e, r


def _text(c):
    return F.concat_ws(",", c).alias(c)


def _subgraph(s, d):
    f, n, e, r = _found(s, d)
    f = cut(f.select("feature", "step_ids"), "features")
    ids, rels = X.subgraph(f, X.surroundings(f, n, e, r), e)
    return ids.groupBy("feature").agg(F.count("*").alias("nodes")).join(rels.groupBy("feature").agg(F.count("*").alias("edges")), "feature", "left").fillna(0)


def _facts(s, d):
    p, u = load(s, d, "part"), load(s, d, "supplier")
    return p.select(F.concat(F.lit("f"), "p_partkey").alias("fact_id"), F.lower(F.concat(F.lit("part_"), "p_partkey")).alias("subject"), F.concat(F.lit("SUPPLIER_"), F.pmod("p_partkey", F.lit(97))).alias("object")).unionByName(
        u.select(F.concat(F.lit("g"), "s_suppkey"), F.concat(F.lit("supplier_"), "s_suppkey"), F.concat(F.lit("nation_"), "s_nationkey")).toDF("fact_id", "subject", "object"))


def _cases(s, d):
    return load(s, d, "orders").select(F.col("o_orderkey").alias("tc_id"), F.array(F.concat(F.lit("customer_"), "o_custkey"), F.concat(F.lit("part_"), F.col("o_orderkey") * 3), F.lit("Nation_1")).alias("source_items"))


def _kept(s, d):
    n, e = flows(s, d)
    return X.stored(X.workflows(n, e, X.workflow_entries(n, e)), n, e)


def _sourced(s, d):
    return load(s, d, "g_nodes").withColumn("source", F.when(F.length("name") % 9 > 0, F.concat(F.lit("REQ-"), F.length("name") % 9)))


def _trace(s, d):
    """Every line item is checked by a case, some of them failing; its order's earlier steps come before it."""
    n, e = (cut(df, "flows") for df in flows(s, d))
    steps = n.filter("seq IS NOT NULL")
    cases = steps.select(F.concat(F.lit("TC-"), "node_id").alias("tc_id"), F.col("name"), F.when(F.col("seq") % 2 == 0, "Negative").otherwise("Positive").alias("tc_type"))
    checks = steps.select(F.concat(F.lit("TC-"), "node_id").alias("tc_id"), "node_id")
    chain = e.filter("rel_type = 'LEADS_TO'").join(n.select(F.col("node_id").alias("src_id"), F.col("source").alias("flow")), "src_id").select("flow", "src_id", "dst_id", F.lit(1).alias("pos"))
    rules = steps.select(F.concat(F.lit("rule_"), "node_id").alias("node_id"), F.when(F.col("seq") % 3 == 0, "BusinessRule").otherwise("Note").alias("node_type"))
    more = steps.select(F.concat(F.lit("rule_"), "node_id").alias("src_id"), F.col("node_id").alias("dst_id"))
    return P.failure_trace(cases, checks, L.dominators(chain).select("node_id", "dominator"), n.select("node_id", "node_type").unionByName(rules), e.select("src_id", "dst_id").unionByName(more)).groupBy("tc_id", "kind").agg(F.count("*").alias("n"))


def _whole_report(s, d):
    e = load(s, d, "g_edges")
    n = load(s, d, "g_nodes")
    return P.structure(n, e)


QUERIES = {
    "gr10_features": lambda s, d: X.numbered(_found(s, d)[0]).select("number", "feature", "entry_id", "size", _text("walk"), _text("actors"), _text("decisions"), _text("ends")),
    "prj20_feature_subgraph": _subgraph,
    "prj32_contract": lambda s, d: X.contract(_found(s, d)[0]),
    "ui05_cards": lambda s, d: X.cards(_found(s, d)[0]).select("feature", "n_branches", "n_actors"),
    "gr11_workflows": lambda s, d: X.workflows(*flows(s, d), X.workflow_entries(*flows(s, d))).select("entry_id", "node_id", "depth", _text("actors")),
    "top08_fallback_entries": lambda s, d: X.workflow_entries(flows(s, d)[0].filter("node_type <> 'Feature'"), flows(s, d)[1]),
    "gr13_item_walks": lambda s, d: X.item_walks(*flows(s, d)),
    "prj28_isolation": lambda s, d: P.isolation(flows(s, d)[0], flows(s, d)[1].filter("rel_type <> 'TRIGGERS'")).groupBy("reason", "node_type").agg(F.count("*").alias("n")),
    "prj28_health": lambda s, d: P.health(load(s, d, "g_nodes"), load(s, d, "g_edges")),
    "prj31_structure_flags": _whole_report,
    "jn13_facts_by_ends": lambda s, d: P.facts_on_edges(_facts(s, d), load(s, d, "g_edges").filter("rel_type IN ('ASSOCIATED_WITH', 'PART_OF')")),
    "agg13_node_coverage": lambda s, d: P.entity_coverage(_facts(s, d), load(s, d, "g_nodes").filter("node_type IN ('Country', 'Location', 'SystemComponent')"), load(s, d, "g_edges")),
    "agg21_generation_summary": lambda s, d: P.generation_summary(load(s, d, "events").select(F.col("event_id").alias("tc_id"), F.col("event_type").alias("scenario"), (F.col("event_id") % 10 == 0).alias("fallback"), (F.col("event_id") % 7 == 0).alias("gap"))),
    "agg22_mean_scores": lambda s, d: P.mean_scores(load(s, d, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 12).alias("clarity"), F.lit(None).cast("bigint").alias("coverage"))),
    "agg16_scenario_score": lambda s, d: P.scenario_score(load(s, d, "events").select(F.when(F.col("event_id") % 5 == 0, "negative").when(F.col("event_id") % 7 == 0, "edge").otherwise("positive").alias("scenario")), X.contract(_found(s, d)[0])),
    "agg12_workflow_accuracy": lambda s, d: P.workflow_accuracy(*flows(s, d), flows(s, d)[0].filter("seq IS NOT NULL").select(F.col("source").alias("feature"), F.col("seq").alias("pos"), "node_id")),
    "jn19_joined_steps": lambda s, d: P.joined_steps(flows(s, d)[0].filter("seq IS NOT NULL").select(F.col("source").alias("feature"), F.col("seq").alias("pos"), "node_id"), flows(s, d)[1].filter("pmod(length(src_id), 2) = 0")),
    "snk13_verifies": lambda s, d: P.verifies(_cases(s, d), load(s, d, "g_nodes")),
    "snk13_unresolved": lambda s, d: P.unresolved(_cases(s, d).withColumnRenamed("source_items", "graph_nodes"), load(s, d, "g_nodes")),
    "jn22_contained_names": lambda s, d: P.contained_nodes(load(s, d, "nation").join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("step_id"), F.concat(F.lit("Open "), "n_name", F.lit(" of "), "r_name").alias("text")), load(s, d, "g_nodes").filter("node_type IN ('Country', 'Location')").withColumn("ord", F.when(F.col("node_type") == "Country", 100).otherwise(0) + F.regexp_extract("node_id", r"(\d+)", 1).cast("int"))),
    "jn14_coverage": lambda s, d: P.coverage(load(s, d, "part").select(F.concat(F.lit("feature_"), "p_partkey").alias("node_id"), F.concat("p_name", F.lit("_"), "p_type").alias("name")), load(s, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("text")), load(s, d, "lineitem").select(F.concat(F.lit("feature_"), "l_partkey").alias("src_id"), F.concat(F.lit("feature_"), "l_suppkey").alias("dst_id"))),
    "jn28_grounded": lambda s, d: P.grounded(load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("Part_"), "l_partkey")).alias("entities")).withColumnRenamed("l_orderkey", "tc_id"), load(s, d, "part").filter("p_size <= 45").select(F.concat(F.lit("part_"), "p_partkey").alias("token"))).select("tc_id"),
    "jn27_proposals": lambda s, d: P.accepted(load(s, d, "lineitem").select(F.concat(F.lit("order_"), "l_orderkey").alias("src_id"), F.concat(F.lit("part_"), F.col("l_partkey") + 3).alias("dst_id"), F.when(F.col("l_linenumber") % 3 == 0, "LIKES").otherwise("USES").alias("rel_type")), load(s, d, "g_nodes"))[0].groupBy("rel_type").agg(F.count("*").alias("n")),
    "snk07_stored_edges": lambda s, d: _kept(s, d)[1].select("src_id", "dst_id", "rel_type", "feature_name"),
    "snk07_stored_nodes": lambda s, d: _kept(s, d)[0].groupBy("node_type", "feature_name").agg(F.count("*").alias("n")),
    "src20_reloaded": lambda s, d: X.reloaded(*_kept(s, d)),
    "jn21_failure_trace": _trace,
    "prj17_catalog": lambda s, d: P.catalog(_sourced(s, d)).groupBy("source").agg(F.count("*").alias("n"), F.min("node_id").alias("lowest")),
    "prj17_catalog_lines": lambda s, d: P.catalog_lines(P.catalog(_sourced(s, d)), "REQ-6", 3000),
    "prj18_tokens": lambda s, d: P.token_set(P.catalog(_sourced(s, d))).agg(F.count("*").alias("n"), F.min("token").alias("lowest"), F.max("token").alias("highest")),
    "agg26_plan_statistics": lambda s, d: P.plan_statistics(load(s, d, "ver_a_nodes"), load(s, d, "ver_b_nodes"), load(s, d, "ver_a_edges"), load(s, d, "ver_b_edges")),
}

_FX = f"{cte('fx_steps')}, fxn AS ({FX_NODES}), fxe AS ({FX_EDGES})"
_F = f"""{_FX}, deg AS (SELECT src_id, count(*) AS n FROM fxe GROUP BY 1),
st AS (SELECT s.*, coalesce(d.n, 0) AS n, s.k = 1 AND o % 2 = 1 AS free FROM fx_steps s LEFT JOIN deg d ON d.src_id = s.node_id),
ent AS (SELECT o, arg_min(node_id, (CASE WHEN free THEN 0 ELSE 1 END, CASE WHEN free THEN 0 ELSE -n END, node_id)) AS entry_id FROM st GROUP BY o),
ft AS (SELECT st.o, least(min(st.node_id), min(CASE WHEN st.o % 2 = 0 THEN 'actor_' || st.o ELSE st.node_id END)) AS feature, entry_id, CAST(count(*) + CASE WHEN st.o % 2 = 0 THEN 1 ELSE 0 END AS INT) AS size,
string_agg(st.node_id, ',' ORDER BY CASE WHEN st.k >= e.k THEN 0 ELSE 1 END, st.k) AS walk, CASE WHEN st.o % 2 = 0 THEN 'Buyer ' || st.o ELSE '' END AS actors,
coalesce(string_agg(st.node_id, ',' ORDER BY st.node_id) FILTER (st.n > 1), '') AS decisions, coalesce(string_agg(st.node_id, ',' ORDER BY st.node_id) FILTER (st.n = 0), '') AS ends
FROM st JOIN ent USING (o) JOIN fx_steps e ON e.node_id = ent.entry_id GROUP BY st.o, entry_id)"""
_G = cte("g_nodes", "g_edges")
_FACTS = """fa AS (SELECT 'f' || p_partkey AS fact_id, 'part_' || p_partkey AS subject, 'supplier_' || (p_partkey % 97) AS object FROM part UNION ALL SELECT 'g' || s_suppkey, 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier)"""
_IN = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"

SQL = {
    "gr10_features": f"{_F} SELECT CAST(row_number() OVER (ORDER BY size DESC, feature) - 1 AS INT) AS number, feature, entry_id, size, walk, actors, decisions, ends FROM ft",
    "prj32_contract": f"{_F} SELECT feature, TRUE AS positive, contains(ends, 'error') OR decisions <> '' AS negative, decisions <> '' AS edge, decisions <> '' AS alternate, contains(ends, 'error') AS failure_retry FROM ft",
    "ui05_cards": f"{_F} SELECT feature, CAST(len(string_split(decisions, ',')) - CASE WHEN decisions = '' THEN 1 ELSE 0 END AS INT) AS n_branches, CASE WHEN actors = '' THEN 0 ELSE 1 END AS n_actors FROM ft",
    "gr11_workflows": f"""{_FX}, r AS (SELECT node_id AS entry_id, node_id, 0 AS depth FROM fxn WHERE node_type = 'Feature' UNION SELECT r.entry_id, e.dst_id, r.depth + 1 FROM r JOIN fxe e ON e.src_id = r.node_id WHERE e.rel_type <> 'PERFORMS'),
m AS (SELECT entry_id, node_id, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT entry_id, m.node_id, depth, coalesce(n.name, '') AS actors FROM m LEFT JOIN fxe p ON p.rel_type = 'PERFORMS' AND p.dst_id = m.node_id LEFT JOIN fxn n ON n.node_id = p.src_id""",
    "top08_fallback_entries": f"{_FX} SELECT node_id FROM fxn WHERE node_type NOT IN ('Feature', 'Actor') AND node_id IN (SELECT src_id FROM fxe) AND node_id NOT IN (SELECT dst_id FROM fxe) ORDER BY node_id LIMIT 20",
    "prj28_isolation": f"{_FX}, e AS (SELECT * FROM fxe WHERE rel_type <> 'TRIGGERS') SELECT 'no relationships' AS reason, node_type, count(*) AS n FROM fxn WHERE node_id NOT IN (SELECT src_id FROM e UNION SELECT dst_id FROM e) GROUP BY 2",
    "prj28_health": f"{_G}, f AS (SELECT src_id AS x FROM g_edges WHERE rel_type IN ('PERFORMS', 'LEADS_TO', 'PRODUCES') UNION SELECT dst_id FROM g_edges WHERE rel_type IN ('PERFORMS', 'LEADS_TO', 'PRODUCES')), c AS (SELECT count(*) AS nodes, count(*) FILTER (node_id NOT IN (FROM f)) AS isolated FROM g_nodes) SELECT nodes, isolated, CASE WHEN nodes = 0 THEN 'Empty Graph' WHEN isolated = 0 THEN 'Excellent' WHEN isolated / nodes < 0.15 THEN 'Good' WHEN isolated / nodes < 0.35 THEN 'Fair' ELSE 'Needs Review' END AS health FROM c",
    "jn13_facts_by_ends": f"{_G}, {_FACTS}, e AS (SELECT lower(src_id) AS s, lower(dst_id) AS d FROM g_edges WHERE rel_type IN ('ASSOCIATED_WITH', 'PART_OF')) SELECT fact_id, EXISTS (SELECT 1 FROM e WHERE {_IN('s', 'subject')} AND {_IN('d', 'object')}) AS matched FROM fa",
    "agg13_node_coverage": f"""{_G}, {_FACTS}, n AS (SELECT * FROM g_nodes WHERE node_type IN ('Country', 'Location', 'SystemComponent')), x AS (SELECT subject AS e FROM fa UNION SELECT object FROM fa), nn AS (SELECT DISTINCT lower(name) AS g FROM n),
c AS (SELECT count(*) AS entities, count(*) FILTER (EXISTS (SELECT 1 FROM nn WHERE {_IN('e', 'g')})) AS covered FROM x), o AS (SELECT count(*) AS nodes, count(DISTINCT node_id) FILTER (node_id NOT IN (SELECT src_id FROM g_edges UNION SELECT dst_id FROM g_edges)) AS orphans FROM n)
SELECT nodes, orphans, round(orphans / nodes, 4) AS orphan_ratio, entities, covered, round(covered / entities, 4) AS raw_coverage, round(round(covered / entities, 4) * (1 - 0.5 * round(orphans / nodes, 4)), 4) AS score FROM c, o""",
    "agg21_generation_summary": "SELECT event_type AS scenario, count(*) AS cases, count(*) FILTER (event_id % 10 = 0) AS fallbacks, count(*) FILTER (event_id % 7 = 0) AS gaps FROM events GROUP BY 1",
    "agg22_mean_scores": "SELECT round(avg(CASE WHEN event_id % 3 > 0 AND event_id % 12 BETWEEN 1 AND 10 THEN event_id % 12 END), 2) AS clarity, 8.5::DOUBLE AS coverage FROM events",
    "agg16_scenario_score": f"""{_F}, c AS (SELECT count(*) FILTER (event_id % 5 = 0) AS negative, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 = 0) AS edge, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS positive FROM events), a AS (SELECT bool_or(contains(ends, 'error')) AS f, bool_or(decisions <> '') AS b FROM ft)
SELECT x.scenario, x.cases, x.expected, CAST(round(100.0 * count(*) FILTER (x.expected AND x.cases > 0) OVER () / greatest(count(*) FILTER (x.expected) OVER (), 1), 1) AS DOUBLE) AS score_pct FROM (SELECT 'positive' AS scenario, positive AS cases, TRUE AS expected FROM c UNION ALL SELECT 'negative', negative, f OR b FROM c, a UNION ALL SELECT 'edge', edge, b FROM c, a UNION ALL SELECT 'alternate', 0, b FROM a UNION ALL SELECT 'failure_retry', 0, f FROM a) x""",
    "jn28_grounded": "SELECT l_orderkey AS tc_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 45 GROUP BY 1 HAVING count(*) = count(p_partkey)",
    "jn27_proposals": "SELECT 'USES' AS rel_type, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey + 3 IN (SELECT p_partkey FROM part)",
    "agg12_workflow_accuracy": f"""{_FX}, s AS (SELECT source, node_id, lead(node_id) OVER (PARTITION BY source ORDER BY seq) AS nxt FROM fxn WHERE seq IS NOT NULL), v AS (SELECT count(*) AS feature_steps, count(DISTINCT source) AS features, count(*) FILTER (EXISTS (SELECT 1 FROM fxe e WHERE e.src_id = s.node_id AND e.dst_id = s.nxt)) AS valid FROM s),
x AS (SELECT count(*) AS flow_edges, (SELECT count(*) FROM (SELECT src_id FROM fxe UNION SELECT dst_id FROM fxe)) AS connected FROM fxe), r AS (SELECT feature_steps AS steps, flow_edges, features, feature_steps, valid, round(connected / feature_steps, 4) AS step_coverage, round(valid / (feature_steps - features), 4) AS transition_accuracy, connected FROM v, x)
SELECT steps, flow_edges, features, feature_steps, valid, step_coverage, transition_accuracy, round(0.5 * step_coverage + 0.5 * transition_accuracy, 4) AS sequence_accuracy, greatest(steps - connected, 0) AS orphans FROM r""",
    "jn19_joined_steps": f"""{_FX}, e AS (SELECT DISTINCT src_id, dst_id FROM fxe WHERE length(src_id) % 2 = 0), s AS (SELECT source AS feature, seq AS pos, node_id, lead(node_id) OVER (PARTITION BY source ORDER BY seq) AS next FROM fxn WHERE seq IS NOT NULL) SELECT feature, pos, node_id, next, e.src_id IS NOT NULL AS joined FROM s LEFT JOIN e ON e.src_id = node_id AND e.dst_id = next WHERE next IS NOT NULL""",
    "snk13_verifies": f"{_G}, c AS (SELECT o_orderkey AS tc_id, unnest(['customer_' || o_custkey, 'part_' || (o_orderkey * 3), 'Nation_1']) AS node_id FROM orders) SELECT DISTINCT tc_id, node_id FROM c WHERE node_id IN (SELECT node_id FROM g_nodes)",
    "snk13_unresolved": f"{_G}, c AS (SELECT o_orderkey AS tc_id, unnest(['customer_' || o_custkey, 'part_' || (o_orderkey * 3), 'nation_1']) AS token FROM orders) SELECT DISTINCT tc_id, token FROM c WHERE token NOT IN (SELECT lower(node_id) FROM g_nodes) AND token NOT IN (SELECT lower(name) FROM g_nodes)",
    "jn22_contained_names": f"{_G}, t AS (SELECT n_nationkey AS step_id, regexp_replace(lower('Open ' || n_name || ' of ' || r_name), '[^a-z0-9]', '', 'g') AS x FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT node_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, CASE WHEN node_type = 'Country' THEN 100 ELSE 0 END + CAST(regexp_extract(node_id, '(\\d+)', 1) AS INT) AS ord FROM g_nodes WHERE node_type IN ('Country', 'Location')) SELECT step_id, arg_max(node_id, ord) AS node_id FROM t JOIN n ON contains(x, k) GROUP BY step_id",
    "snk07_stored_edges": f"""{_FX}, f AS (SELECT o, k, node_id, name FROM fx_steps WHERE node_type = 'Feature'), w AS (SELECT s.node_id, f.name AS feature_name, f.node_id AS entry FROM fx_steps s JOIN f ON f.o = s.o AND s.k >= f.k)
SELECT 'feature_' || replace(name, ' ', '_') AS src_id, node_id AS dst_id, 'HAS_STEP' AS rel_type, name AS feature_name FROM f UNION ALL SELECT DISTINCT src_id, dst_id, 'NEXT', feature_name FROM w JOIN fxe ON src_id = node_id""",
    "snk07_stored_nodes": f"""{_FX}, f AS (SELECT o, k, node_id, name FROM fx_steps WHERE node_type = 'Feature') SELECT 'Feature' AS node_type, name AS feature_name, 1 AS n FROM f UNION ALL SELECT 'WorkflowStep', f.name, count(*) FROM fx_steps s JOIN f ON f.o = s.o AND s.k >= f.k GROUP BY 2""",
    "src20_reloaded": f"""{_FX}, f AS (SELECT o, k, name FROM fx_steps WHERE node_type = 'Feature') SELECT f.name AS feature_name, CAST(row_number() OVER (PARTITION BY f.name ORDER BY s.k) - 1 AS INT) AS pos, s.node_id FROM fx_steps s JOIN f ON f.o = s.o AND s.k >= f.k""",
    "jn21_failure_trace": f"""{_FX}, t AS (SELECT *, count(*) OVER (PARTITION BY o) AS c FROM fx_steps), a AS (SELECT * FROM t WHERE l % 2 = 0 OR l % 4 = 0) SELECT 'TC-' || a.node_id AS tc_id, 'upstream' AS kind, count(*) AS n FROM a JOIN t b ON b.o = a.o AND b.k < a.k GROUP BY 1
UNION ALL SELECT 'TC-' || a.node_id, 'supporting', count(*) FROM a JOIN t b ON b.o = a.o AND b.k <= a.k WHERE b.l % 3 = 0 GROUP BY 1""",
    "prj17_catalog": f"{_G} SELECT 'REQ-' || (length(name) % 9) AS source, count(*) AS n, min(node_id) AS lowest FROM g_nodes WHERE length(name) % 9 > 0 GROUP BY 1",
    "prj17_catalog_lines": f"{_G}, l AS (SELECT node_id, node_id || ' | ' || node_type || ' | ' || name || ' (from REQ-' || (length(name) % 9) || ')' || chr(10) AS line FROM g_nodes WHERE length(name) % 9 NOT IN (0, 6)) SELECT node_id, line FROM (SELECT *, sum(length(line)) OVER (ORDER BY node_id) AS total FROM l) WHERE total <= 3000",
    "prj18_tokens": f"{_G}, c AS (SELECT lower(trim(node_id)) AS i, lower(trim(name)) AS n FROM g_nodes WHERE length(name) % 9 > 0), t AS (SELECT i AS token FROM c UNION SELECT n FROM c UNION SELECT replace(n, ' ', '_') FROM c UNION SELECT replace(n, '_', ' ') FROM c) SELECT count(*) AS n, min(token) AS lowest, max(token) AS highest FROM t",
    "agg26_plan_statistics": f"""{cte('ver_a_nodes', 'ver_b_nodes', 'ver_a_edges', 'ver_b_edges')} SELECT (SELECT count(*) FROM ver_b_nodes WHERE node_id NOT IN (SELECT node_id FROM ver_a_nodes)) AS new_nodes, (SELECT count(*) FROM ver_b_nodes WHERE node_id IN (SELECT node_id FROM ver_a_nodes)) AS known_nodes,
(SELECT count(*) FROM ver_b_edges b WHERE NOT EXISTS (SELECT 1 FROM ver_a_edges a WHERE a.src_id = b.src_id AND a.dst_id = b.dst_id)) AS new_edges, (SELECT count(*) FROM ver_b_edges b WHERE EXISTS (SELECT 1 FROM ver_a_edges a WHERE a.src_id = b.src_id AND a.dst_id = b.dst_id)) AS known_edges""",
}
