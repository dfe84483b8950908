"""Queries: storage, versions, merging and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import retrieval as R
from ..operators import versions as V
from ..sources import storage as S
from .fixtures import cte, load


def _vn(s, d, v):
    return load(s, d, f"ver_{v}_nodes").withColumn("aliases", F.array("alias"))


def _vers(s, d):
    return _vn(s, d, "a"), _vn(s, d, "b"), load(s, d, "ver_a_edges"), load(s, d, "ver_b_edges")


def _stored(s, d):
    c = load(s, d, "customer")
    n = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("doc_id"), F.concat(F.lit("GEN-"), F.lpad((F.col("c_custkey") % 30).cast("string"), 3, "0")).alias("source"), F.col("c_custkey").alias("ord"))
    e = load(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src_id"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("dst_id"), F.col("o_orderstatus").alias("rel_type"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("ord"))
    return n, e


def _upsert(s, d):
    n, _ = _stored(s, d)
    new = n.filter("ord % 3 = 0").withColumn("source", F.lit("fresh")).withColumn("doc_id", F.when(F.col("ord") % 2 == 0, "new"))
    more = new.withColumn("node_id", F.concat(F.lit("x"), "node_id"))
    return S.upsert(n, new.unionByName(more), ["node_id"], ("doc_id",))


def _upsert_edges(s, d):
    n, e = _stored(s, d)
    return S.upsert_edges(e.filter("rel_type = 'O'").limit(0), e, n)


def _query_vector(s, d):
    return [float(x) for x in load(s, d, "embeddings").filter("vec_id = 0").first().embedding]


def _chunks(s, d):
    return load(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _conflicts(s, d):
    return load(s, d, "ver_b_edges"), load(s, d, "ver_a_edges")


def _preserve(s, d):
    new, old = _conflicts(s, d)
    k = F.substring_index("dst_id", "_", -1).cast("int")
    decisions = new.withColumn("decision", F.when(k % 7 == 0, "replace").when(k % 7 == 1, "skip").otherwise("extend"))
    return M.preserve(new, old, decisions)


QUERIES = {
    "snk01_upsert_nodes": _upsert,
    "snk02_upsert_edges": _upsert_edges,
    "snk04_delete_edges": lambda s, d: S.delete_edges(load(s, d, "ver_a_edges"), load(s, d, "ver_b_edges")),
    "src13_document_nodes": lambda s, d: S.document_graph(*_stored(s, d), "BUILDING")[0],
    "src13_document_edges": lambda s, d: S.document_graph(*_stored(s, d), "BUILDING")[1].select("src_id", "dst_id", "rel_type"),
    "src14_documents": lambda s, d: S.documents(_stored(s, d)[0]),
    "src14_generated_range": lambda s, d: S.documents(_stored(s, d)[0].withColumn("doc_id", F.lit(None).cast("string"))),
    "src17_win18_version_chain": lambda s, d: S.version_chain(load(s, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at")), "owner"),
    "top10_latest_version": lambda s, d: load(s, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")),
    "jn09_diff_nodes": lambda s, d: V.diff_nodes(*_vers(s, d)[:2]),
    "jn09_diff_edges": lambda s, d: V.diff_edges(*_vers(s, d)[2:]),
    "jn09_changed_workflow": lambda s, d: V.changed_workflow(*_vers(s, d)[2:]).select("src_id", "rel_type", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "after").alias("after")),
    "jn09_agg27_qa03_summary": lambda s, d: V.summary(*_vers(s, d)),
    "set06_labelled_union": lambda s, d: V.labelled_union(*_vers(s, d)[:2]),
    "jn06_match_entities": lambda s, d: M.match_entities(load(s, d, "vec_new").withColumn("id", F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))), load(s, d, "vec_old")).select("id", "matched_to", "method", F.round("score", 3).alias("score")),
    "jn06_best_match": lambda s, d: M.best_match(load(s, d, "vec_new"), load(s, d, "vec_old")).select("id", "matched_to", F.round("score", 5).alias("score")),
    "jn07_conflicts": lambda s, d: M.conflicts(*_conflicts(s, d)).select("src_id", "rel_type", "new_dst", F.concat_ws(",", "existing").alias("existing")),
    "jn08_preserve_add": lambda s, d: _preserve(s, d)[0],
    "jn08_preserve_remove": lambda s, d: _preserve(s, d)[1],
    "jn20_remap_edges": lambda s, d: M.remap_edges(load(s, d, "ver_a_edges"), load(s, d, "part").filter("p_partkey % 2 = 1").select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.concat(F.lit("part_"), F.col("p_partkey") + 1).alias("matched_to"))),
    "agg25_agg26_checks": lambda s, d: M.checks(_vn(s, d, "b"), load(s, d, "ver_a_edges").unionByName(load(s, d, "ver_b_edges"))),
    "top02_nearest_l2": lambda s, d: R.nearest(_chunks(s, d), _query_vector(s, d), 5).select("id", F.round("score", 5).alias("score")),
    "top02_nearest_level": lambda s, d: R.nearest(_chunks(s, d).filter("label = 3"), _query_vector(s, d), 5).select("id", F.round("score", 5).alias("score")),
    "top03_entity_link": lambda s, d: R.nearest(_chunks(s, d), _query_vector(s, d), 8, "cosine", 0.1).select("id", F.round("score", 5).alias("score")),
    "top04_similarity": lambda s, d: R.nearest(_chunks(s, d), _query_vector(s, d), 5).select("id", F.round(1 - F.col("score"), 4).alias("similarity")),
    "top02_nearest_each": lambda s, d: R.nearest_each(_chunks(s, d).filter("id % 100 = 0").select(F.col("id").alias("q"), F.col("vector").alias("qv")), _chunks(s, d), 3),
    "win08_budget": lambda s, d: R.within_budget(load(s, d, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn"),
    "top09_community_facts": lambda s, d: R.community_facts(load(s, d, "g_nodes").withColumn("community", F.pmod(F.length("name"), F.lit(5))), load(s, d, "g_edges")),
    "prj19_subgraph": lambda s, d: R.subgraph_of_strings(load(s, d, "g_nodes"), load(s, d, "g_edges"), load(s, d, "nation").select(F.upper(F.concat(F.lit("nation_"), "n_nationkey")).alias("s")).unionByName(load(s, d, "region").select(F.lower("r_name").alias("s")))),
    "prj14_api_properties": lambda s, d: R.api_properties(load(s, d, "events").select(F.concat(F.lit("e"), "event_id").alias("node_id"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("node_type"), F.lit(None).cast("string").alias("name"), F.regexp_replace(F.regexp_replace("props", "k", "Secret_k"), r"\}$", ', "color": "red"}').alias("attributes_json"))).select("node_id", F.concat_ws(";", F.array_sort(F.transform(F.map_entries("properties"), lambda x: F.concat_ws("=", x["key"], x["value"])))).alias("properties")),
    "src18_history": lambda s, d: load(s, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("newest")),
    "src19_level_counts": lambda s, d: s.createDataFrame([(0,), (1,), (99,)], "label int").join(load(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n")),
    "src23_prompts": lambda s, d: S.current_prompts(load(s, d, "conversations").select(F.concat(F.lit("p"), "conv_id").alias("name"), F.col("role").alias("label"), F.col("turn").cast("int").alias("version"), F.col("text").alias("template")), load(s, d, "region").select(F.concat(F.lit("p"), F.col("r_regionkey") + 1000000).alias("name"), F.lit("seed").alias("label"), F.lit(1).alias("version"), F.col("r_name").alias("template"))),
    "src15_community": lambda s, d: S.community_nodes(load(s, d, "g_nodes").withColumn("community", F.pmod(F.length("name"), F.lit(5))), load(s, d, "g_edges"), F.lit(2))[1],
}

_V = cte("ver_a_nodes", "ver_b_nodes", "ver_a_edges", "ver_b_edges")
_VE = cte("ver_a_edges", "ver_b_edges")
_DN = "dn AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, CASE WHEN a.node_id IS NULL THEN 'added' WHEN b.node_id IS NULL THEN 'removed' WHEN a.node_type <> b.node_type OR a.description IS DISTINCT FROM b.description OR a.alias <> b.alias THEN 'modified' END AS status FROM ver_a_nodes a FULL JOIN ver_b_nodes b ON a.node_id = b.node_id)"
_DE = "de AS (SELECT *, 'added' AS status FROM (FROM ver_b_edges EXCEPT FROM ver_a_edges) UNION ALL SELECT *, 'removed' FROM (FROM ver_a_edges EXCEPT FROM ver_b_edges))"
_CW = "ta AS (SELECT src_id, rel_type, string_agg(DISTINCT dst_id, ',' ORDER BY dst_id) AS t FROM ver_a_edges GROUP BY 1, 2), tb AS (SELECT src_id, rel_type, string_agg(DISTINCT dst_id, ',' ORDER BY dst_id) AS t FROM ver_b_edges GROUP BY 1, 2), cw AS (SELECT ta.src_id, ta.rel_type, ta.t AS before, tb.t AS after FROM ta JOIN tb ON ta.src_id = tb.src_id AND ta.rel_type = tb.rel_type WHERE ta.t <> tb.t)"
_ST = "WITH n AS (SELECT concat('c', c_custkey) AS node_id, c_mktsegment AS doc_id, concat('GEN-', lpad(CAST(c_custkey % 30 AS VARCHAR), 3, '0')) AS source, c_custkey AS ord FROM customer), e AS (SELECT concat('c', o_custkey) AS src_id, concat('c', o_custkey + 1) AS dst_id, o_orderstatus AS rel_type, o_orderpriority AS source, o_orderkey AS ord FROM orders)"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_L2 = "pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)"
_NEW = "nw AS (SELECT CASE WHEN vec_id % 10 = 1 THEN vec_id - 1 ELSE vec_id END AS id, embedding FROM embeddings WHERE vec_id % 2 = 1)"
_PR = "f AS (SELECT b.*, CAST(split_part(dst_id, '_', -1) AS INT) % 7 AS k FROM ver_b_edges b WHERE NOT EXISTS (SELECT 1 FROM ver_a_edges a WHERE a.src_id = b.src_id AND a.dst_id = b.dst_id AND a.rel_type = b.rel_type))"
SQL = {
    "snk01_upsert_nodes": f"{_ST}, w AS (SELECT node_id, CASE WHEN ord % 2 = 0 THEN 'new' ELSE doc_id END AS doc_id, 'fresh' AS source, ord FROM n WHERE ord % 3 = 0) SELECT * FROM n WHERE ord % 3 <> 0 UNION ALL SELECT * FROM w UNION ALL SELECT 'x' || node_id, CASE WHEN ord % 2 = 0 THEN 'new' END, source, ord FROM w",
    "snk02_upsert_edges": f"{_ST}, s AS (SELECT * FROM e WHERE src_id IN (SELECT node_id FROM n) AND dst_id IN (SELECT node_id FROM n)) SELECT src_id, dst_id, rel_type, arg_max(source, ord) AS source, max(ord) AS ord FROM s GROUP BY 1, 2, 3",
    "snk04_delete_edges": f"{_VE} FROM ver_a_edges EXCEPT FROM ver_b_edges",
    "src13_document_nodes": f"{_ST} SELECT * FROM n WHERE doc_id = 'BUILDING'",
    "src13_document_edges": f"{_ST} SELECT DISTINCT src_id, dst_id, rel_type FROM e WHERE src_id IN (SELECT node_id FROM n WHERE doc_id = 'BUILDING') AND dst_id IN (SELECT node_id FROM n WHERE doc_id = 'BUILDING')",
    "src14_documents": "SELECT DISTINCT c_mktsegment AS name FROM customer",
    "src14_generated_range": f"{_ST} SELECT min(source) || ' to ' || max(source) AS name FROM n",
    "src17_win18_version_chain": "SELECT o_custkey AS owner, o_orderkey AS version_id, o_orderdate AS created_at, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_id FROM orders",
    "top10_latest_version": "SELECT o_custkey AS owner, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "jn09_diff_nodes": f"{_V}, {_DN} SELECT * FROM dn WHERE status IS NOT NULL",
    "jn09_diff_edges": f"{_VE}, {_DE} SELECT * FROM de",
    "jn09_changed_workflow": f"{_VE}, {_CW} SELECT * FROM cw",
    "jn09_agg27_qa03_summary": f"{_V}, {_DN}, {_DE}, {_CW} SELECT status || '_nodes' AS what, count(*) AS n FROM dn WHERE status IS NOT NULL GROUP BY 1 UNION ALL SELECT status || '_edges', count(*) FROM de GROUP BY 1 UNION ALL SELECT 'changed_workflow', count(*) FROM cw",
    "set06_labelled_union": f"{_V}, {_DN} SELECT node_id, coalesce(status, 'unchanged') AS status FROM dn",
    "jn06_match_entities": f"WITH {_NEW}, m AS (SELECT a.id, arg_max(b.vec_id, {_COS}) AS t, max({_COS}) AS s FROM nw a JOIN embeddings b ON b.vec_id % 2 = 0 GROUP BY a.id) SELECT id, CASE WHEN id % 2 = 0 THEN id WHEN s >= 0.9 THEN t END AS matched_to, CASE WHEN id % 2 = 0 THEN 'exact_id' WHEN s >= 0.9 THEN 'semantic' ELSE 'unmatched' END AS method, CASE WHEN id % 2 = 0 THEN 1.0::DOUBLE WHEN s >= 0.9 THEN round(s, 3) END AS score FROM m",
    "jn06_best_match": f"SELECT a.vec_id AS id, arg_max(b.vec_id, {_COS}) AS matched_to, round(max({_COS}), 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1 GROUP BY 1",
    "jn07_conflicts": f"{_VE}, {_CW} SELECT b.src_id, b.rel_type, b.dst_id AS new_dst, ta.t AS existing FROM ver_b_edges b JOIN ta ON ta.src_id = b.src_id AND ta.rel_type = b.rel_type WHERE NOT list_contains(string_split(ta.t, ','), b.dst_id)",
    "jn08_preserve_add": f"{_VE}, {_PR} SELECT src_id, dst_id, rel_type FROM f WHERE k <> 1",
    "jn08_preserve_remove": f"{_VE}, {_PR} SELECT DISTINCT a.* FROM ver_a_edges a WHERE EXISTS (SELECT 1 FROM f WHERE k = 0 AND f.src_id = a.src_id AND f.rel_type = a.rel_type)",
    "jn20_remap_edges": f"{cte('ver_a_edges')} SELECT DISTINCT src_id, CASE WHEN k % 2 = 1 THEN concat('part_', k + 1) ELSE dst_id END AS dst_id, rel_type FROM (SELECT *, CAST(split_part(dst_id, '_', -1) AS INT) AS k FROM ver_a_edges) t",
    "agg25_agg26_checks": f"{_V}, u AS (FROM ver_a_edges UNION ALL FROM ver_b_edges), k AS (SELECT * FROM u WHERE src_id IN (SELECT node_id FROM ver_b_nodes) AND dst_id IN (SELECT node_id FROM ver_b_nodes)) SELECT 'duplicate_edges' AS problem, (SELECT count(*) FROM k) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k)) AS n UNION ALL SELECT 'dangling_edges', (SELECT count(*) FROM u) - (SELECT count(*) FROM k) UNION ALL SELECT 'isolated_nodes', (SELECT count(*) FROM ver_b_nodes WHERE node_id NOT IN (SELECT src_id FROM u UNION SELECT dst_id FROM u))",
    "top02_nearest_l2": f"SELECT a.vec_id AS id, round({_L2}, 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 0 ORDER BY {_L2}, id LIMIT 5",
    "top02_nearest_level": f"SELECT a.vec_id AS id, round({_L2}, 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 0 WHERE a.label = 3 ORDER BY {_L2}, id LIMIT 5",
    "top03_entity_link": f"SELECT a.vec_id AS id, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 0 WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, id LIMIT 8",
    "top04_similarity": f"SELECT a.vec_id AS id, round(1 - {_L2}, 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = 0 ORDER BY {_L2}, id LIMIT 5",
    "top02_nearest_each": f"SELECT b.vec_id AS q, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_L2}, a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 QUALIFY rank <= 3",
    "win08_budget": "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) t WHERE s <= 400 OR n = 1",
    "top09_community_facts": f"{cte('g_nodes', 'g_edges')}, k AS (SELECT node_id, CAST(length(name) % 5 AS INT) AS c FROM g_nodes QUALIFY row_number() OVER (PARTITION BY length(name) % 5 ORDER BY node_id) <= 25) SELECT a.c AS community, src_id, dst_id, rel_type FROM g_edges JOIN k a ON a.node_id = src_id JOIN k b ON b.node_id = dst_id WHERE a.c = b.c",
    "prj19_subgraph": f"{cte('g_edges')} SELECT * FROM g_edges WHERE rel_type = 'PART_OF'",
    "prj14_api_properties": "SELECT concat('e', event_id) AS node_id, 'color=red;label=e' || event_id || ';type=' || CASE WHEN event_id % 3 > 0 THEN event_type ELSE 'Entity' END AS properties FROM events",
    "src18_history": "SELECT user_id, event_id, props->>'$.k' AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS newest FROM events",
    "src19_level_counts": "SELECT l AS label, count(vec_id) AS n FROM (VALUES (0), (1), (99)) v(l) LEFT JOIN embeddings ON label = l GROUP BY 1",
    "src23_prompts": "SELECT concat('p', conv_id) AS name, arg_max(role, turn) AS label, CAST(max(turn) AS INT) AS version, arg_max(text, turn) AS template FROM conversations GROUP BY 1 UNION ALL SELECT concat('p', r_regionkey + 1000000), 'seed', 1, r_name FROM region",
    "src15_community": f"{cte('g_nodes', 'g_edges')}, k AS (SELECT node_id FROM g_nodes WHERE length(name) % 5 = 2) SELECT * FROM g_edges WHERE src_id IN (FROM k) AND dst_id IN (FROM k)",
}
