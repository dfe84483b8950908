"""Queries: texts around extraction, the graph's interface, stored sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import api
from ..operators import extraction as X
from ..sources import shared
from ..sources import storage as S
from .fixtures import cte, flows, load


def _g(s, d):
    return load(s, d, "g_nodes").withColumn("source", F.concat(F.lit("REQ-"), F.pmod(F.length("name"), F.lit(9)))), load(s, d, "g_edges")


def _page(s, d, **how):
    return api.page(*_g(s, d), **how)


def _raw(s, d):
    return load(s, d, "raw_nodes")


def _paragraphs(s, d):
    return load(s, d, "conversations").filter("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("bigint").alias("pos"), F.col("text").alias("content"))


def _shortcuts(s, d):
    """Branching flows whose actors also point at every step; every second actor has an entry of its own."""
    n, e = flows(s, d)
    steps = n.filter("node_type <> 'Actor'")
    more = steps.select(F.regexp_replace("source", "REQ-", "actor_").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("USES").alias("rel_type"))
    first = n.filter("node_type <> 'Actor'").groupBy("source").agg(F.min_by("node_id", F.struct("seq", "node_id")).alias("entry_id"))
    number = F.regexp_replace("source", "REQ-", "").cast("long")
    owned = first.select(F.when(number % 4 == 0, F.regexp_replace("source", "REQ-", "actor_")).alias("actor_id"), "entry_id")
    return X.without_actor_shortcuts(e.unionByName(more), n.filter("node_type = 'Actor'"), steps, owned)


def _saved(s, d):
    """A graph stored in two generations; what is read back is the last one, tagged with its batch."""
    folder = f"{shared.folder(s)}/stored"
    n = load(s, d, "ver_a_nodes")
    S.save(n, folder)
    S.save(S.inserted(n, load(s, d, "ver_b_nodes"), "batch-2"), folder)
    return S.latest(s, folder)


def _snapshots(s, d):
    folder = f"{shared.folder(s)}/versions"
    for v in ("a", "b"):
        S.snapshot(load(s, d, f"ver_{v}_nodes"), load(s, d, f"ver_{v}_edges"), folder, v, f"version {v}")
    return S.version_chain(s.read.parquet(f"{folder}/versions")).select("version_id", "label", "node_count", "edge_count", "previous_id")


def _runs(s, d):
    folder = f"{shared.folder(s)}/runs"
    S.append_evaluation(load(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders")), folder)
    return s.read.parquet(folder).select("o_orderstatus", "orders", "details")


def _prompts(s, d):
    base = load(s, d, "region").select(F.lower("r_name").alias("name"), F.lit("first").alias("label"), F.lit(1).alias("version"), F.concat(F.lit("{text} of "), "r_name").alias("template"))
    return S.delete_prompt(S.save_prompt(S.save_prompt(base, "asia", "second", "{text}!", ("text",)), "new", "first", "{text}", ("text",)), "europe")


def _communities(s, d):
    n, _ = _g(s, d)
    return S.community_sizes(S.with_communities(n, n.select("node_id", F.pmod(F.length("name"), F.lit(7)).alias("community"))))


def _vectors(s, d):
    new = load(s, d, "vec_new").withColumn("id", F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))).withColumn("ord", F.col("id"))
    old = load(s, d, "vec_old").withColumn("ord", F.col("id"))
    return S.upsert(old, new, ["id"]).select("id", "label")


QUERIES = {
    "prj07_metadata_texts": lambda s, d: load(s, d, "notes").select("note_id", X.metadata_reason(F.col("text")).alias("reason")),
    "prj08_procedural_texts": lambda s, d: load(s, d, "notes").select("note_id", X.is_procedural(F.col("text")).alias("procedural")),
    "prj07_document_lines": lambda s, d: load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", X.metadata_reason(F.col("line")).alias("reason")).filter("reason is not null"),
    "prj08_procedural_documents": lambda s, d: load(s, d, "documents").select("doc_id", X.is_procedural(F.col("text")).alias("procedural")),
    "prj03_set01_tagged": lambda s, d: X.together([X.tagged(_raw(s, d), F.lit("ITEM-1"), F.lit("doc-1")), X.tagged(_raw(s, d).drop("description"), F.col("node_type"))]).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count("description").alias("described")),
    "prj30_actor_edges": _shortcuts,
    "win09_batches": lambda s, d: X.batches(_paragraphs(s, d)).groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("pos").alias("first")),
    "win07_generated_ids": lambda s, d: X.generated_ids(_paragraphs(s, d)).select("doc_id", "pos", "item_id"),
    "prj16_page_nodes": lambda s, d: _page(s, d, kind=" country ", limit=20, skip=3).nodes.select("node_id", "node_type", "name"),
    "prj16_page_edges": lambda s, d: _page(s, d, kind="All", limit=2000).edges,
    "prj16_page_about": lambda s, d: _page(s, d, doc="REQ-6", relation="PART_OF", limit=50).about,
    "src25_summary": lambda s, d: api.summary(*_g(s, d)),
    "src25_neighbours": lambda s, d: api.neighbourhood(*_g(s, d), load(s, d, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("node_id")), 2, "in")[0].groupBy("node_type", "depth").agg(F.count("*").alias("n")),
    "src21_sql": lambda s, d: api.sql(s, "SELECT e.rel_type, n.node_type, count(*) AS n FROM {edges} e JOIN {nodes} n ON n.node_id = e.src_id GROUP BY 1, 2", *_g(s, d)),
    "src11_nodes": lambda s, d: S.typed_nodes(load(s, d, "events").select(F.concat(F.lit("e"), "event_id").alias("node_id"), F.col("event_type").alias("node_type"), F.col("props").alias("attributes_json"))).select("node_id", "node_type", F.col("attributes")["k"].alias("k")),
    "src12_edges": lambda s, d: api.resolved(load(s, d, "g_edges"), load(s, d, "g_nodes").filter("node_type <> 'DataObject'"))[0],
    "jn01_unresolved": lambda s, d: api.resolved(load(s, d, "raw_edges"), _raw(s, d))[1].groupBy("rel_type").agg(F.count("*").alias("n")),
    "snk03_insert": lambda s, d: _saved(s, d),
    "snk05_delete_all": lambda s, d: S.cleared(_g(s, d)[0])[1],
    "snk06_communities": _communities,
    "snk08_snapshots": _snapshots,
    "snk09_runs": _runs,
    "snk12_vectors": _vectors,
    "snk14_prompts": _prompts,
    "set05_tokens": lambda s, d: S.tokens(load(s, d, "g_nodes").withColumn("gen", F.lit(0)).unionByName(load(s, d, "g_nodes").filter("node_type = 'Country'").select(F.lower(F.concat(F.lit("new "), "node_id")).alias("node_id"), "node_type", "name", "seq").withColumn("gen", F.lit(1)))).groupBy("kind").agg(F.count("*").alias("n"), F.min("token").alias("lowest"), F.min("node_id").alias("id")),
    "ui01_dashboard": lambda s, d: api.summary(*_g(s, d)).filter("what in ('total', 'node type')").withColumn("rank", F.rank().over(__import__("pyspark").sql.Window.partitionBy("what").orderBy(F.desc("n"), "name"))),
    "top07_most_ways": lambda s, d: load(s, d, "g_edges").groupBy("src_id").agg(F.count("*").alias("outdeg")).agg(F.max_by("src_id", F.struct("outdeg", "src_id")).alias("node_id"), F.max("outdeg").alias("outdeg")),
}

_NOTES, _G = cte("notes"), cte("g_nodes", "g_edges")
_S = "(SELECT *, 'REQ-' || (length(name) % 9) AS source FROM g_nodes)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _reason(c: str) -> str:
    low = rf"regexp_replace(lower({c}), '^\s+|\s+$', '', 'g')"
    words = " + ".join(f"CAST(contains({low}, {_q(w)}) AS INT)" for w in X.METADATA_WORDS)
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {words} >= 2 THEN 'document_control_table' WHEN regexp_matches({low}, {_q(X.PAGE_LINE)}) THEN 'page_header_footer' WHEN regexp_matches({low}, {_q(X.PAGE_ARTIFACT)}) THEN 'page_artifact' END"


def _procedural(c: str) -> str:
    t = f"coalesce({c}, '')"
    return rf"length(regexp_replace({t}, '^\s+|\s+$', '', 'g')) >= 40 AND NOT regexp_matches({t}, {_q(X.any_of(X.OTHER_SIGNS))}) AND regexp_matches({t}, {_q(X.any_of(X.PROCEDURE_SIGNS))})"


_FX = cte("fx_steps")
_FXG = f"""fn AS (SELECT node_id, node_type, o, l, k FROM fx_steps), fe AS (SELECT a.node_id AS src_id, b.node_id AS dst_id, CASE WHEN b.k - a.k = 1 THEN 'LEADS_TO' ELSE 'TRIGGERS' END AS rel_type FROM fx_steps a JOIN fx_steps b ON a.o = b.o AND (b.k = a.k + 1 OR (b.k = a.k + 2 AND a.l % 2 = 1)))"""

SQL = {
    "prj07_metadata_texts": f"{_NOTES} SELECT note_id, {_reason('text')} AS reason FROM notes",
    "prj08_procedural_texts": f"{_NOTES} SELECT note_id, {_procedural('text')} AS procedural FROM notes",
    "prj07_document_lines": f"WITH l AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT doc_id, line_no, {_reason('line')} AS reason FROM l) WHERE reason IS NOT NULL",
    "prj08_procedural_documents": f"SELECT doc_id, {_procedural('text')} AS procedural FROM documents",
    "prj03_set01_tagged": f"{cte('raw_nodes')} SELECT 'ITEM-1' AS source, 'doc-1' AS doc_id, count(*) AS n, count(description) AS described FROM raw_nodes UNION ALL SELECT node_type, NULL, count(*), 0 FROM raw_nodes GROUP BY 1",
    "prj30_actor_edges": f"{_FX}, {_FXG} SELECT src_id, dst_id, rel_type FROM fe UNION ALL SELECT 'actor_' || o, node_id, 'PERFORMS' FROM fn WHERE k = 1 AND o % 2 = 0 UNION ALL SELECT 'actor_' || o, node_id, 'USES' FROM fn WHERE o % 2 = 1 OR k = 1",
    "win07_generated_ids": "SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS pos, 'GEN-' || CASE WHEN n > 999 THEN left(CAST(n AS VARCHAR), 3) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL)",
    "win09_batches": """WITH RECURSIVE p AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS pos, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
f AS (SELECT doc_id, pos, i, 1 AS batch, 1 AS rows, len + 5 AS chars FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.pos, p.i, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN 1 ELSE rows + 1 END, CASE WHEN full_ THEN p.len + 5 ELSE chars + p.len + length(CAST(rows + 1 AS VARCHAR)) + 4 END
FROM (SELECT f.*, p.len AS nlen, (f.rows >= 10 OR f.chars + p.len + length(CAST(f.rows + 1 AS VARCHAR)) + 4 > 2000) AS full_ FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1) g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1)
SELECT doc_id, CAST(batch AS INT) AS batch, count(*) AS n, min(pos) AS first FROM f GROUP BY 1, 2""",
    "prj16_page_nodes": f"{_G} SELECT node_id, node_type, name FROM g_nodes WHERE lower(node_type) = 'country' ORDER BY node_id LIMIT 20 OFFSET 3",
    "prj16_page_edges": f"{_G}, p AS (SELECT node_id FROM g_nodes ORDER BY node_id LIMIT 2000) SELECT src_id, dst_id, rel_type, 'edge:' || src_id || '-' || rel_type || '->' || dst_id || ':' || (row_number() OVER (PARTITION BY src_id, dst_id, rel_type) - 1) AS edge_id FROM g_edges WHERE src_id IN (FROM p) AND dst_id IN (FROM p)",
    "prj16_page_about": f"{_G}, p AS (SELECT node_id FROM {_S} WHERE source = 'REQ-6' ORDER BY node_id LIMIT 50) SELECT (SELECT count(*) FROM p) AS node_count, (SELECT count(*) FROM g_edges WHERE rel_type = 'PART_OF' AND src_id IN (FROM p) AND dst_id IN (FROM p)) AS edge_count, (SELECT count(*) FROM g_nodes) AS total_nodes, (SELECT count(*) FROM g_edges) AS total_edges, (SELECT count(*) FROM p) >= 50 AS truncated",
    "src25_summary": f"{_G}, s AS (SELECT * FROM {_S}) SELECT 'total' AS what, 'nodes' AS name, count(*) AS n FROM g_nodes UNION ALL SELECT 'total', 'edges', count(*) FROM g_edges UNION ALL SELECT 'node type', node_type, count(*) FROM g_nodes GROUP BY 2 UNION ALL SELECT 'relation', rel_type, count(*) FROM g_edges GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2",
    "src25_neighbours": f"{_G} SELECT 'Location' AS node_type, 0 AS depth, count(*) AS n FROM region UNION ALL SELECT 'Country', 1, count(*) FROM nation UNION ALL SELECT node_type, 2, count(*) FROM g_nodes WHERE node_id IN (SELECT src_id FROM g_edges WHERE rel_type = 'ASSOCIATED_WITH') GROUP BY 1",
    "src21_sql": f"{_G} SELECT e.rel_type, n.node_type, count(*) AS n FROM g_edges e JOIN g_nodes n ON n.node_id = e.src_id GROUP BY 1, 2",
    "src11_nodes": "SELECT 'e' || event_id AS node_id, event_type AS node_type, json_extract_string(props, '$.k') AS k FROM events",
    "src12_edges": f"{_G} SELECT * FROM g_edges WHERE rel_type NOT IN ('USES', 'PRODUCES')",
    "jn01_unresolved": f"{cte('raw_nodes', 'raw_edges')} SELECT rel_type, count(*) AS n FROM raw_edges WHERE src_id NOT IN (SELECT node_id FROM raw_nodes) OR dst_id NOT IN (SELECT node_id FROM raw_nodes) GROUP BY 1",
    "snk03_insert": f"{cte('ver_a_nodes', 'ver_b_nodes')} SELECT *, 'batch-2' AS batch_id FROM ver_b_nodes UNION ALL SELECT *, NULL FROM ver_a_nodes WHERE node_id NOT IN (SELECT node_id FROM ver_b_nodes)",
    "snk05_delete_all": f"{_G} SELECT count(*) AS deleted FROM g_nodes",
    "snk06_communities": f"{_G} SELECT CAST(length(name) % 7 AS INT) AS community, count(*) AS size FROM g_nodes GROUP BY 1",
    "snk08_snapshots": f"{cte('ver_a_nodes', 'ver_b_nodes', 'ver_a_edges', 'ver_b_edges')} SELECT 'a' AS version_id, 'version a' AS label, (SELECT count(*) FROM ver_a_nodes) AS node_count, (SELECT count(*) FROM ver_a_edges) AS edge_count, NULL AS previous_id UNION ALL SELECT 'b', 'version b', (SELECT count(*) FROM ver_b_nodes), (SELECT count(*) FROM ver_b_edges), 'a'",
    "snk09_runs": """SELECT o_orderstatus, count(*) AS orders, '{"o_orderstatus":"' || o_orderstatus || '","orders":' || count(*) || '}' AS details FROM orders GROUP BY 1""",
    "snk12_vectors": f"{cte('vec_old', 'vec_new')}, n AS (SELECT CASE WHEN id % 10 = 1 THEN id - 1 ELSE id END AS id, label FROM vec_new) SELECT id, label FROM n UNION ALL SELECT id, label FROM vec_old WHERE id NOT IN (SELECT id FROM n)",
    "snk14_prompts": "SELECT lower(r_name) AS name, 'first' AS label, 1 AS version, '{text} of ' || r_name AS template FROM region WHERE lower(r_name) <> 'europe' UNION ALL SELECT 'asia', 'second', 2, '{text}!' UNION ALL SELECT 'new', 'first', 1, '{text}'",
    "set05_tokens": f"{_G}, e AS (SELECT node_id, name, 0 AS gen FROM g_nodes UNION ALL SELECT lower('new ' || node_id), name, 1 FROM g_nodes WHERE node_type = 'Country'), i AS (SELECT lower(trim(node_id)) AS token, min(node_id) AS node_id FROM e GROUP BY 1), m AS (SELECT lower(trim(name)) AS token, arg_min(node_id, gen || node_id) AS node_id FROM e WHERE name IS NOT NULL GROUP BY 1) SELECT 'id' AS kind, count(*) AS n, min(token) AS lowest, min(node_id) AS id FROM i UNION ALL SELECT 'name', count(*), min(token), min(node_id) FROM m WHERE token NOT IN (SELECT token FROM i)",
    "ui01_dashboard": f"{_G}, u AS (SELECT 'total' AS what, 'nodes' AS name, count(*) AS n FROM g_nodes UNION ALL SELECT 'total', 'edges', count(*) FROM g_edges UNION ALL SELECT 'node type', node_type, count(*) FROM g_nodes GROUP BY 2) SELECT *, CAST(rank() OVER (PARTITION BY what ORDER BY n DESC, name) AS INT) AS rank FROM u",
    "top07_most_ways": f"{_G} SELECT src_id AS node_id, count(*) AS outdeg FROM g_edges GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1",
}
