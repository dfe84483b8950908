"""Queries: context of steps and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import roles as R
from ..operators import testcases as T
from .fixtures import cte, load


def _n(s, d):
    return load(s, d, "g_nodes").withColumn("source", F.concat(F.lit("REQ-"), F.length("name"), F.lit("-"), F.col("node_type")))


def _steps(s, d):
    return load(s, d, "orders").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("order_"), "o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("name"))


def _groups(s, d):
    return load(s, d, "part").groupBy(F.concat(F.lit("group "), "p_brand").alias("name")).agg(F.collect_list(F.concat(F.lit("part_"), "p_partkey")).alias("members"))


def _ev_cases(s, d, who="user_id IS NOT NULL"):
    e = load(s, d, "events").filter(who)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.initcap(x["event_type"]))
    return T.transitions(e.groupBy(F.col("user_id").cast("string").alias("tc_id")).agg(steps.alias("steps")))


def _ev_nodes(s, d):
    return load(s, d, "events").select(F.concat(F.lit("n_"), "event_type").alias("node_id"), F.col("event_type").alias("name")).distinct()


def _ev_edges(s, d):
    return load(s, d, "ev_edges").filter("src_id < dst_id").select(F.concat(F.lit("n_"), "src_id").alias("src_id"), F.concat(F.lit("n_"), "dst_id").alias("dst_id"))


def _lines(s, d):
    c = load(s, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" Title: "), "text")).otherwise(F.col("text")).alias("line"))



def _chunk_texts(s, d):
    k, nl = F.col("o_orderkey"), chr(10)
    part = lambda n, text: F.when(k % n == 0, text)
    return load(s, d, "orders").select(k.alias("doc_id"), F.concat_ws(" ", part(2, F.concat(F.lit("NFR-"), F.lpad("o_custkey", 4, "0"), F.lit(":"))), part(3, F.lit("br-001 uc-123: x")), part(5, F.lit("US-100: then Story 7: told")), part(7, F.lit(f"req9999: TS-123:{nl}1.2 Scope of it{nl}2.3.1 more{nl}"))).alias("text"))


QUERIES = {
    "jn17_supporting": lambda s, d: C.supporting(load(s, d, "g_nodes").filter("node_type = 'Actor'"), load(s, d, "g_edges"), R.classify_nodes(load(s, d, "g_nodes"))),
    "jn18_set03_items_without_nodes": lambda s, d: C.without_nodes(load(s, d, "items_v").select("item_id"), load(s, d, "part").select(F.concat(F.lit("BR-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("source"))),
    "jn23_series": lambda s, d: C.series(_n(s, d).select(F.col("source").alias("item_id")).distinct(), load(s, d, "g_edges").filter("rel_type IN ('PART_OF', 'ASSOCIATED_WITH')"), _n(s, d)).groupBy("series").agg(F.count("*").alias("n")).agg(F.sum("n").alias("items"), F.count("*").alias("series")),
    "jn24_item_subgraph": lambda s, d: C.item_subgraph(_n(s, d), load(s, d, "g_edges").filter("rel_type = 'PERFORMS'")).groupBy("item_id").agg(F.count("*").alias("n")),
    "jn26_collapse": lambda s, d: C.collapse(load(s, d, "g_edges").filter("rel_type = 'PRODUCES'"), _groups(s, d)),
    "jn22_step_nodes": lambda s, d: C.step_nodes(_ev_cases(s, d), _ev_nodes(s, d)),
    "agg17_path_validity": lambda s, d: C.path_validity(C.step_nodes(_ev_cases(s, d), _ev_nodes(s, d)), _ev_edges(s, d)),
    # The same over all users; the SQL twins read the users below 20.
    "agg12_workflow_quality": lambda s, d: C.workflow_quality(_steps(s, d), load(s, d, "g_edges").filter("rel_type = 'LEADS_TO'")),
    "agg09_chunk_patterns": lambda s, d: C.chunk_patterns(_chunk_texts(s, d)),
    "agg09_strategy": lambda s, d: C.chunk_strategy(_chunk_texts(s, d)),
    "win11_win07_labelled_items": lambda s, d: C.labelled_items(_lines(s, d)),
    "win12_without_repeats": lambda s, d: C.without_repeats(_steps(s, d)),
    "prj13_item_checks": lambda s, d: C.item_checks(load(s, d, "part").select(F.lit(1).alias("doc_id"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("FR-"), F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("GEN-"), "p_partkey")).otherwise(F.concat(F.lit("item "), "p_partkey")).alias("item_id"), (F.col("p_size") > 10).alias("native"), F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("content"), F.col("p_partkey").alias("ord"))).select("ord", F.array_join("reasons", "; ").alias("reasons")),
}
_G = cte("g_nodes", "g_edges")
_EV = "s AS (SELECT user_id::VARCHAR AS tc_id, CAST(row_number() OVER w - 1 AS INT) AS pos, event_type AS a, lead(event_type) OVER w AS b FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_CHUNKS = (
    "WITH t AS (SELECT o_orderkey AS doc_id, concat_ws(' ', CASE WHEN o_orderkey % 2 = 0 THEN 'NFR-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || ':' END, CASE WHEN o_orderkey % 3 = 0 THEN 'br-001 uc-123: x' END, CASE WHEN o_orderkey % 5 = 0 THEN 'US-100: then Story 7: told' END, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'req9999: TS-123:' || chr(10) || '1.2 Scope of it' || chr(10) || '2.3.1 more' || chr(10) END) AS text FROM orders), c AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(text, '(?is){p}')) AS n FROM t" for k, p in C.CHUNK_PATTERNS.items()) + ")"
)

SQL = {
    "jn17_supporting": f"{_G} SELECT DISTINCT src_id AS step_id, dst_id AS node_id, rel_type, 'other' AS role FROM g_edges WHERE rel_type = 'ASSOCIATED_WITH' AND src_id LIKE 'customer%'",
    "jn18_set03_items_without_nodes": f"{cte('items_v')} SELECT item_id FROM items_v WHERE family = 'FR'",
    "jn24_item_subgraph": f"{_G}, n AS (SELECT node_id, 'REQ-' || length(name) || '-' || node_type AS s FROM g_nodes), p AS (SELECT src_id AS a, dst_id AS b FROM g_edges WHERE rel_type = 'PERFORMS' UNION ALL SELECT dst_id, src_id FROM g_edges WHERE rel_type = 'PERFORMS'), u AS (SELECT s, node_id FROM n UNION SELECT s, b FROM n JOIN p ON a = node_id) SELECT s AS item_id, count(*) AS n FROM u GROUP BY 1",
    "jn26_collapse": f"{cte('g_edges')} SELECT DISTINCT src_id, 'group ' || p_brand AS dst_id, rel_type FROM g_edges JOIN part ON dst_id = 'part_' || p_partkey WHERE rel_type = 'PRODUCES'",
    "jn22_step_nodes": f"WITH {_EV} SELECT tc_id, pos, upper(a[1]) || a[2:] AS step, upper(b[1]) || b[2:] AS next, 'n_' || a AS src_id, 'n_' || b AS dst_id FROM s WHERE b IS NOT NULL",
    "agg17_path_validity": f"WITH {_EV}, k AS (SELECT count(*) AS checked, count(*) FILTER (WHERE a < b) AS valid FROM s WHERE b IS NOT NULL) SELECT checked, valid, round(valid * 100 / checked, 1) AS pct FROM k",
    "agg12_workflow_quality": f"{cte('g_edges')}, s AS (SELECT concat('order_', o_orderkey) AS a, concat('order_', lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS b, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS h FROM orders), l AS (SELECT * FROM g_edges WHERE rel_type = 'LEADS_TO'), k AS (SELECT count(*) AS transitions, count(*) FILTER (WHERE (a, b) IN (SELECT (src_id, dst_id) FROM l)) AS joined FROM s WHERE h IS NOT NULL) SELECT transitions, joined, (SELECT count(*) FROM s WHERE a NOT IN (SELECT src_id FROM l UNION SELECT dst_id FROM l)) AS orphans, round(joined / transitions, 4) AS accuracy FROM k",
    "agg09_chunk_patterns": f"{_CHUNKS} SELECT doc_id, pattern, CAST(n AS INT) AS n FROM c WHERE n > 0",
    "agg09_strategy": f"{_CHUNKS} SELECT doc_id, CAST(sum(n) AS BIGINT) AS patterns, CASE WHEN sum(n) > 0 THEN 'pattern-based' ELSE 'semantic-fallback' END AS strategy FROM c GROUP BY doc_id",
    "win11_win07_labelled_items": "WITH l AS (SELECT conv_id, turn, text, turn % 3 = 1 AS t, count(*) FILTER (WHERE turn % 3 = 1) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id AS doc_id, 'GEN-' || lpad(k::VARCHAR, 3, '0') AS item_id, max(CASE WHEN t THEN text END) AS title, string_agg(CASE WHEN t THEN ' Title: ' || text ELSE text END, chr(10) ORDER BY turn) AS content FROM l WHERE k > 0 GROUP BY conv_id, k",
    "win12_without_repeats": "SELECT flow, pos, node_id, name FROM (SELECT o_custkey AS flow, o_orderkey AS pos, concat('order_', o_orderkey) AS node_id, o_orderstatus AS name, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) t WHERE p IS NULL OR p <> name",
    "prj13_item_checks": "WITH i AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'FR-' || lpad((p_partkey % 40)::VARCHAR, 3, '0') WHEN p_partkey % 5 = 1 THEN 'GEN-' || p_partkey ELSE 'item ' || p_partkey END AS id, p_size > 10 AS native, CASE WHEN p_size % 7 > 0 THEN p_type END AS c FROM part) SELECT ord, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END, CASE WHEN NOT native THEN 'foreign family' END, CASE WHEN length(trim(coalesce(c, ''))) < 10 THEN 'short content' END, CASE WHEN id LIKE 'item%' THEN 'no known id' END) AS reasons FROM i",
}
