"""Queries: texts, items, chunks, test cases, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O
from ..operators import evaluation as E
from ..operators import testcases as T
from ..operators import textual as X
from ..sources import blocks as B
from .fixtures import cte, load


def _items(s, d):
    return load(s, d, "items_v")


def _docs(s, d):
    return load(s, d, "documents").select("doc_id", "text")


def _tcs(s, d):
    c = load(s, d, "conversations")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), F.max_by("text", "turn").alias("expected_result"), steps.alias("steps")).select(F.concat(F.lit("TC-"), "conv_id").alias("tc_id"), "title", F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("precondition"), "expected_result", "steps", F.col("conv_id").alias("ord"))


def _parts(s, d):
    p = load(s, d, "part")
    k = F.col("p_size") % 4
    steps = F.array(F.concat(F.lit("Navigate to "), "p_brand", F.lit(".")), F.when(k == 0, F.concat(F.lit("Enter "), "p_name", F.lit("."))).when(k == 1, F.concat(F.lit("Click "), "p_name", F.lit("."))).otherwise(F.concat(F.lit("Perform "), "p_type", F.lit("."))), F.lit("Verify result is displayed."))
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("tc_id"), F.col("p_brand").alias("feature"), F.lit("Positive").alias("tc_type"), steps.alias("steps"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("precondition"), F.col("p_type").alias("expected_result"), F.when(k == 0, "edge").alias("scenario"))


def _cue_docs(s, d):
    cue = F.element_at(F.array(*map(F.lit, ("retry now", "an invalid pin", "the upper limit", "another branch", "all fine"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _parts(s, d).withColumn("p", F.col("ord")).withColumn("expected_result", F.element_at(F.array(*map(F.lit, ("retry now", "an invalid pin", "the upper limit", "another branch", "all fine"))), (F.col("ord") % 5 + 1).cast("int"))).drop("p")


def _id_docs(s, d):
    o = load(s, d, "orders")
    text = F.concat_ws(" ", F.lit("Scope and business rule of the user story."), F.concat(F.lit("FR-"), F.lpad("o_orderkey", 6, "0")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see BR_PAY_HEAD_"), "o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("and NFR-"), F.lpad("o_custkey", 3, "0"))), F.when(F.col("o_orderkey") % 5 == 0, F.lit("Story 12 test case TC-001 tc-002")))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _link(s, d):
    return X.link_items(_items(s, d))


def _blocks(s, d):
    return B.text_blocks(_docs(s, d))


def _facts(s, d, which="s_suppkey IS NOT NULL"):
    n = load(s, d, "nation")
    f = load(s, d, "supplier").filter(which).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return f.select(F.col("s_suppkey").alias("fact_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("the "), "n_name")).when(F.col("s_suppkey") % 3 == 1, F.lit("nobody at all")).otherwise(F.col("n_name")).alias("subject"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("zz yy")).otherwise(F.concat(F.lit("REGION "), (F.col("n_regionkey")).cast("string"))).alias("object"))


def _fact_graph(s, d):
    n, r = load(s, d, "nation"), load(s, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("REGION "), F.col("r_regionkey").cast("string")), F.col("r_regionkey") + 100).toDF("node_id", "name", "ord"))
    return nodes, n.select(F.concat(F.lit("n"), "n_nationkey").alias("src_id"), F.concat(F.lit("r"), "n_regionkey").alias("dst_id"))


def _chunk_items(s, d):
    return load(s, d, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit("I"), "doc_id").alias("item_id"), F.col("text").alias("content"))


QUERIES = {
    "jn05_links": lambda s, d: _link(s, d)[0],
    "jn05_broken_references": lambda s, d: _link(s, d)[1],
    "win14_mentions": lambda s, d: X.find_mentions(_id_docs(s, d), "text"),
    "agg08_family_counts": lambda s, d: X.family_counts(_id_docs(s, d)),
    "agg08_document_type": lambda s, d: X.detect_type(_id_docs(s, d)),
    "agg24_completeness": lambda s, d: X.completeness(_id_docs(s, d).select("doc_id", F.col("text").alias("before"), F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 50)).otherwise(F.col("text")).alias("after"))),
    "src05_text_blocks": lambda s, d: _blocks(s, d).select("doc_id", "block_no", "kind", F.length("content").alias("n")),
    "src05_block_counts": lambda s, d: _blocks(s, d).groupBy("kind").agg(F.count("*").alias("n")),
    "snk10_markdown": lambda s, d: B.to_markdown(_blocks(s, d)),
    "snk10_plain_text": lambda s, d: B.plain_text(_blocks(s, d).filter("kind <> 'table'")),
    "win10_anchored_items": lambda s, d: B.anchored_items(load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.when(F.col("turn") % 5 == 4, "heading").otherwise("paragraph").alias("kind"), F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("FR-"), F.lpad("turn", 3, "0"), F.lit(" "))).otherwise(F.lit("")), "text").alias("content")), r"FR-\d{3,}"),
    "src07_spreadsheet": lambda s, d: B.excel_requirements(load(s, d, "part").select(F.col("p_partkey").alias("row_no"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Req "), "p_partkey")).alias("Req ID"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("Requirement"), F.when(F.col("p_partkey") % 2 > 0, F.col("p_brand")).alias("Area"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("Name")), {"id": ("id", "req id"), "title": ("title", "name"), "description": ("description", "requirement"), "module": ("module", "area")}),
    "txt01_whole_chunks": lambda s, d: X.chunks(_chunk_items(s, d)).filter("not is_split").select("doc_id", "chunk_id"),
    "txt02_win05_split_chunks": lambda s, d: X.chunks(_chunk_items(s, d)).filter("is_split").select("item_id", "chunk_id", F.length("text").alias("n")),
    "win04_look_back": lambda s, d: X.look_back(load(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("item_id"), F.col("turn").alias("ord"), (F.col("turn") % 2 == 1).alias("is_split"), "text")).select("doc_id", "ord", "previous", "continues"),
    "win15_first_of_prefix": lambda s, d: X.first_of_prefix(load(s, d, "conversations").select(F.col("role").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text"), 6).select("doc_id", "ord"),
    "txt06_text_facts": lambda s, d: E.text_facts(load(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("System part shall use "), "p_name", F.lit(". "), F.col("p_type"), F.lit(" with four plain words here! Short.")).alias("text"))),
    "jn12_match_facts": lambda s, d: E.match_facts(_facts(s, d), *_fact_graph(s, d)),
    "agg10_retention": lambda s, d: E.retention(E.match_facts(_facts(s, d), *_fact_graph(s, d))),
    # The same over all suppliers, links and edges; the SQL twins read a part of them.
    "agg05_set02_sequence_scores": lambda s, d: E.sequence_scores(load(s, d, "ver_b_edges"), load(s, d, "ver_a_edges")),
    "agg11_relationship_quality": lambda s, d: E.relationship_quality(load(s, d, "ver_b_nodes"), load(s, d, "ver_a_edges").withColumn("rel_type", F.when(F.length("dst_id") % 2 == 0, "ODD").otherwise(F.col("rel_type"))), O.RELATIONS),
    "agg14_overall": lambda s, d: load(s, d, "region").select("r_regionkey", E.overall(F.col("r_regionkey") / 10, F.lit(0.5), F.lit(0.25), F.lit(1.0)).alias("with_facts"), E.overall(None, F.col("r_regionkey") / 10, F.lit(0.25), F.lit(1.0)).alias("without")),
    "agg15_node_coverage": lambda s, d: E.node_coverage(load(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("name")), load(s, d, "part").filter("p_partkey % 9 = 0").select(F.concat_ws(" ", "p_name", "p_type").alias("text"))),
    "prj21_full_text": lambda s, d: T.full_text(_tcs(s, d)).select("tc_id", "title", "full_text"),
    "prj22_enrich": lambda s, d: T.enrich(_cue_docs(s, d)).select("tc_id", "scenario_type", "objective"),
    "prj23_classify": lambda s, d: T.classify(_cue_docs(s, d)).select("tc_id", "class"),
    "agg16_scenario_counts": lambda s, d: T.classify(_cue_docs(s, d)).groupBy("class").agg(F.count("*").alias("n")),
    "prj24_negative_items": lambda s, d: T.negative_items(_cue_docs(s, d).select(F.col("tc_id").alias("item_id"), F.col("expected_result").alias("content"))),
    "prj25_priorities": lambda s, d: T.priorities(_items(s, d), _link(s, d)[0]),
    "prj26_phrases": lambda s, d: load(s, d, "g_edges").join(load(s, d, "g_nodes").withColumnRenamed("node_id", "dst_id"), "dst_id").select("src_id", "dst_id", "rel_type", T.phrase(F.col("rel_type"), F.col("name"), F.col("node_type")).alias("step")),
    "agg20_duplicates": lambda s, d: T.duplicates(_parts(s, d).withColumn("title", F.col("feature"))),
    "agg20_duplication": lambda s, d: T.duplication(_parts(s, d).withColumn("title", F.col("feature"))),
    "tc02_variants": lambda s, d: T.variants(_parts(s, d)).select("tc_id", "tc_type", "title", F.array_join("steps", " ").alias("steps")),
    "win06_case_ids": lambda s, d: T.case_ids(_parts(s, d).withColumn("req_id", F.col("feature"))).select("ord", F.col("tc_id")),
    "agg18_grounding": lambda s, d: T.grounding(_parts(s, d), load(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(load(s, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_name").alias("name")))),
    "snk13_jn16_validates": lambda s, d: T.validates_edges(_parts(s, d).withColumn("graph_nodes", F.array(F.upper("title"), F.concat(F.lit("Part_"), "ord"), F.lit("none such"))), load(s, d, "g_nodes").filter("node_type = 'DataObject'")),
    "snk15_render": lambda s, d: T.render(_tcs(s, d)),
    "win13_jn19_transitions": lambda s, d: T.transitions(_tcs(s, d)),
}

_I = cte("items_v")
_LINK = """m AS (SELECT DISTINCT item_id, family, unnest(regexp_extract_all(content, 'BR-[0-9]{3,}')) AS t FROM items_v WHERE family = 'FR')"""
_T = "t AS (SELECT 'TC-' || conv_id AS tc_id, conv_id, arg_min(text, turn) AS title, arg_max(text, turn) AS er, list(text ORDER BY turn) AS steps FROM conversations GROUP BY conv_id)"
_P = """p AS (SELECT 'P' || p_partkey AS tc_id, p_partkey AS ord, p_brand AS feature, p_name AS title, p_type, CASE WHEN p_size % 4 = 0 THEN 'edge' END AS scenario,
['Navigate to ' || p_brand || '.', CASE p_size % 4 WHEN 0 THEN 'Enter ' || p_name || '.' WHEN 1 THEN 'Click ' || p_name || '.' ELSE 'Perform ' || p_type || '.' END, 'Verify result is displayed.'] AS steps,
['retry now', 'an invalid pin', 'the upper limit', 'another branch', 'all fine'][p_partkey % 5 + 1] AS er FROM part)"""
_IDD = """x AS (SELECT o_orderkey AS doc_id, concat_ws(' ', 'Scope and business rule of the user story.', 'FR-' || lpad(o_orderkey::VARCHAR, 6, '0'), CASE WHEN o_orderkey % 3 = 0 THEN 'see BR_PAY_HEAD_' || o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'and NFR-' || lpad(o_custkey::VARCHAR, 3, '0') END, CASE WHEN o_orderkey % 5 = 0 THEN 'Story 12 test case TC-001 tc-002' END) AS text,
o_orderkey % 3 = 0 AS br, o_orderkey % 2 = 0 AS nfr, o_orderkey % 5 = 0 AS tc, o_custkey FROM orders)"""
_W4 = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], w)))"
_BLOCKS = r"""l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, i AS n, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l0)),
k AS (SELECT *, CASE WHEN contains(s, '|') THEN 'row' WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(s, '^[-*•]\s+') THEN 'bullet' WHEN regexp_matches(s, '^[0-9]{1,3}[.)]\s+') THEN 'numbered'
WHEN length(s) <= 60 AND regexp_matches(s, '^[A-Z0-9][A-Z0-9 \-/&:]{2,60}$') AND len(regexp_split_to_array(s, '\s+')) <= 8 THEN 'capitals' ELSE 'paragraph' END AS k FROM l),
r AS (SELECT *, sum(CASE WHEN k = 'row' AND prev = 'row' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM k)),
c AS (SELECT doc_id, run, n, k, CASE WHEN k = 'row' THEN list_transform(string_split(regexp_replace(s, '^\|+|\|+$', '', 'g'), '|'), lambda q: trim(q)) END AS cells, s FROM r WHERE k <> 'blank'),
g AS (SELECT doc_id, run, min(n) AS n, first(k) AS k, first(s) AS s, list(array_to_string(cells, ' | ') ORDER BY n) FILTER (WHERE len(list_filter(cells, lambda q: q <> '')) > 0) AS rows FROM c GROUP BY doc_id, run),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_no, CASE WHEN k = 'row' THEN CASE WHEN len(rows) >= 2 THEN 'table' ELSE 'paragraph' END WHEN k IN ('heading', 'capitals') THEN 'heading' WHEN k IN ('bullet', 'numbered') THEN 'list_item' ELSE 'paragraph' END AS kind,
k, rows, CASE WHEN k = 'row' THEN array_to_string(rows, chr(10)) WHEN k = 'heading' THEN trim(regexp_replace(s, '^#{1,6}\s+', '')) WHEN k IN ('bullet', 'numbered') THEN trim(regexp_replace(s, '^([-*•]|[0-9]{1,3}[.)])\s+', '')) ELSE s END AS content FROM g WHERE k <> 'row' OR len(rows) > 0)"""
_F = """f AS (SELECT s_suppkey AS fact_id, CASE s_suppkey % 3 WHEN 0 THEN 'the ' || n_name WHEN 1 THEN 'nobody at all' ELSE n_name END AS subject, CASE WHEN s_suppkey % 5 = 0 THEN 'zz yy' ELSE 'REGION ' || n_regionkey END AS object, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
fn AS (SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey AS ord FROM nation UNION ALL SELECT 'r' || r_regionkey, 'REGION ' || r_regionkey, r_regionkey + 100 FROM region),
h AS (SELECT e, arg_max(id, ord) AS id FROM (SELECT subject AS e FROM f UNION SELECT object FROM f) q JOIN fn ON contains(regexp_replace(lower(e), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(e), '[^a-z0-9]', '', 'g')) OR len(list_intersect(string_split(lower(e), ' '), string_split(lower(name), ' '))) / len(list_distinct(list_concat(string_split(lower(e), ' '), string_split(lower(name), ' ')))) >= 0.6 GROUP BY e),
mf AS (SELECT fact_id, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE 'n' || n_nationkey IN (a.id, b.id) AND 'r' || n_regionkey IN (a.id, b.id)) THEN 'verified' WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'partially_verified' ELSE 'missing' END AS status FROM f LEFT JOIN h a ON a.e = subject LEFT JOIN h b ON b.e = object),
ms AS (SELECT *, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'partially_verified' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM mf)"""
_CUE = "lower(concat_ws(' ', title, er, array_to_string(steps, ' ')))"
_CLASS = "CASE WHEN scenario = 'edge' THEN 'edge' " + " ".join(f"WHEN contains(lower(title), '{c}') THEN '{c}'" for c in ("positive", "negative", "edge")) + " " + " ".join(f"WHEN regexp_matches({_CUE}, '\\b({'|'.join(w)})\\b') THEN '{c}'" for c, w in T.CUES) + " ELSE 'positive' END"
_SIG = "lower(regexp_replace(feature || array_to_string(steps, '>'), '[^A-Za-z0-9>]', '', 'g'))"
SQL = {
    "jn05_links": f"{_I}, {_LINK} SELECT m.item_id AS source_id, t AS target_id, 'REALIZES' AS link_type, t AS evidence FROM m WHERE t IN (SELECT item_id FROM items_v)",
    "jn05_broken_references": f"{_I}, {_LINK} SELECT m.item_id AS source_id, t AS referenced_text FROM m WHERE t NOT IN (SELECT item_id FROM items_v)",
    "win14_mentions": f"WITH {_IDD}, a AS (SELECT doc_id, text, 'FR' AS family_of, 'FR-' || lpad(doc_id::VARCHAR, 6, '0') AS mention FROM x UNION ALL SELECT doc_id, text, 'BR', 'BR_PAY_HEAD_' || o_custkey FROM x WHERE br UNION ALL SELECT doc_id, text, 'NFR', 'NFR-' || lpad(o_custkey::VARCHAR, 3, '0') FROM x WHERE nfr UNION ALL SELECT doc_id, text, 'US_PROSE', 'Story 12' FROM x WHERE tc UNION ALL SELECT doc_id, text, 'TC', 'TC-001' FROM x WHERE tc UNION ALL SELECT doc_id, text, 'TC', 'tc-002' FROM x WHERE tc) SELECT doc_id, family_of, mention, CAST(strpos(text, mention) - 1 AS INT) AS pos FROM a",
    "agg08_family_counts": f"WITH {_IDD} SELECT doc_id, 'FR' AS family, 1 AS n FROM x UNION ALL SELECT doc_id, 'BR', 1 FROM x WHERE br UNION ALL SELECT doc_id, 'NFR', 1 FROM x WHERE nfr UNION ALL SELECT doc_id, 'US_PROSE', 1 FROM x WHERE tc UNION ALL SELECT doc_id, 'TC', 2 FROM x WHERE tc",
    "agg08_document_type": f"""WITH {_IDD}, y AS (SELECT doc_id, br::INT AS b, 1 + nfr::INT AS r, tc::INT AS u, 2 * tc::INT AS t FROM x), z AS (SELECT doc_id, unnest([{{'t': 'BRD', 's': 0.65::DOUBLE * b / (b + r + u + t) + 0.35 * 2 / (3 + (t > 0)::INT)}}, {{'t': 'SRS', 's': 0.65::DOUBLE * r / (b + r + u + t)}}, {{'t': 'USER_STORY_DOC', 's': 0.65::DOUBLE * u / (b + r + u + t) + 0.35 / (3 + (t > 0)::INT)}}, {{'t': 'TEST_PLAN', 's': 0.65::DOUBLE * t / (b + r + u + t) + 0.35 * (t > 0)::INT / (3 + (t > 0)::INT)}}]) AS q FROM y),
w AS (SELECT doc_id, q.t AS t, q.s AS s, lead(q.s) OVER (PARTITION BY doc_id ORDER BY q.s DESC, q.t DESC) AS s2, row_number() OVER (PARTITION BY doc_id ORDER BY q.s DESC, q.t DESC) AS k FROM z) SELECT doc_id, CASE WHEN s < 0.35 THEN 'UNKNOWN' WHEN s - s2 < 0.10 THEN 'MIXED' ELSE t END AS doc_type, round(s, 4) AS score FROM w WHERE k = 1""",
    "agg24_completeness": f"""WITH {_IDD}, y AS (SELECT doc_id, text AS b, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 50) ELSE text END AS a FROM x), z AS (SELECT doc_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(b, '(?i)\\b[A-Z]{{1,4}}-[0-9]{{3,}}\\b'), lambda q: upper(q))), lambda q: NOT contains(upper(a), q))) AS lost, round(len(list_filter(string_split(a, ' '), lambda q: q <> '')) / len(string_split(b, ' ')), 3) AS ratio FROM y) SELECT *, lost > 0 OR ratio < 0.6 AS flagged FROM z""",
    "src05_text_blocks": f"WITH {_BLOCKS} SELECT doc_id, block_no, kind, length(content) AS n FROM b",
    "src05_block_counts": f"WITH {_BLOCKS} SELECT kind, count(*) AS n FROM b GROUP BY kind",
    "snk10_plain_text": f"WITH {_BLOCKS} SELECT doc_id, string_agg(content, chr(10) ORDER BY block_no) AS text FROM b WHERE kind <> 'table' GROUP BY doc_id",
    "win10_anchored_items": "WITH b AS (SELECT conv_id, turn, turn % 5 = 4 AS h, CASE WHEN turn % 2 = 0 THEN 'FR-' || lpad(turn::VARCHAR, 3, '0') END AS own, CASE WHEN turn % 2 = 0 THEN 'FR-' || lpad(turn::VARCHAR, 3, '0') || ' ' ELSE '' END || text AS c FROM conversations), a AS (SELECT *, max(CASE WHEN own IS NOT NULL OR h THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM b) SELECT conv_id AS doc_id, max(CASE WHEN turn = k THEN own END) AS item_id, string_agg(c, chr(10) ORDER BY turn) AS content FROM a GROUP BY conv_id, k HAVING max(CASE WHEN turn = k THEN own END) IS NOT NULL",
    "src07_spreadsheet": "SELECT CASE WHEN p_partkey % 3 > 0 THEN 'req_' || p_partkey ELSE 'row_' || p_partkey END AS row_id, CASE WHEN p_size > 25 THEN p_name ELSE substr(p_type, 1, 60) END AS title, p_type AS description, CASE WHEN p_partkey % 2 > 0 THEN p_brand ELSE 'Unspecified' END AS module FROM part WHERE p_partkey % 5 > 0",
    "txt01_whole_chunks": "SELECT source AS doc_id, 'I' || doc_id AS chunk_id FROM documents WHERE length(text) <= 3500 AND trim(text) <> ''",
    "win04_look_back": "SELECT conv_id AS doc_id, turn AS ord, lag(text) OVER w AS previous, coalesce(lag(role) OVER w = role AND turn % 2 = 1, false) AS continues FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "win15_first_of_prefix": "SELECT role AS doc_id, min(conv_id * 1000 + turn) AS ord FROM conversations GROUP BY role, substr(text, 1, 6)",
    "txt06_text_facts": "SELECT p_partkey AS doc_id, 1 AS fact_no, 'System part' AS subject, 'SHALL' AS predicate, substr('use ' || p_name || '.', 1, 60) AS object, 'requirement_fact' AS kind FROM part UNION ALL SELECT p_partkey, 2, string_split(p_type, ' ')[1], 'DESCRIBES', array_to_string(string_split(p_type || ' with four plain words here!', ' ')[2:5], ' '), 'text_fact' FROM part",
    "jn12_match_facts": f"WITH {_F} SELECT * FROM ms",
    "agg10_retention": f"WITH {_F}, a AS (SELECT count(*) AS facts, sum(score) / count(*) AS r, (count(*) FILTER (WHERE status = 'verified') + 0.5::DOUBLE * count(*) FILTER (WHERE status = 'partially_verified')) / count(*) AS q FROM ms) SELECT facts, round(r, 4) AS recall, round(q, 4) AS precision, round(2 * r * q / (r + q), 4) AS f1 FROM a",
    "agg05_set02_sequence_scores": f"{cte('ver_a_edges', 'ver_b_edges')}, c AS (SELECT (SELECT count(*) FROM ver_a_edges) AS t, (SELECT count(*) FROM ver_b_edges) AS f, (SELECT count(*) FROM (FROM ver_a_edges INTERSECT FROM ver_b_edges)) AS h) SELECT round(h / f, 3) AS precision, round(h / t, 3) AS recall, round(2 * (h / f) * (h / t) / (h / f + h / t), 3) AS f1 FROM c",
    "agg11_relationship_quality": f"{cte('ver_b_nodes', 'ver_a_edges')}, e AS (SELECT src_id IN (SELECT node_id FROM ver_b_nodes) AS a, dst_id IN (SELECT node_id FROM ver_b_nodes) AS b, length(dst_id) % 2 = 1 AS ok FROM ver_a_edges) SELECT count(*) AS edges, count(*) FILTER (WHERE NOT a AND NOT b) AS dangling, round(count(*) FILTER (WHERE a AND b) / count(*), 4) AS connectivity, round(count(*) FILTER (WHERE ok) / count(*), 4) AS valid_types FROM e",
    "agg14_overall": "SELECT r_regionkey, round(0.35::DOUBLE * r_regionkey / 10 + 0.125 + 0.0625 + 0.15, 4) AS with_facts, round(0.1::DOUBLE + 0.35::DOUBLE * r_regionkey / 10 + 0.0875 + 0.2, 4) AS without FROM region",
    "agg15_node_coverage": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS w FROM part WHERE p_partkey % 9 = 0), n AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda q: length(q) >= 3)) AS t FROM part), h AS (SELECT p_partkey, count(*) AS k FROM (SELECT p_partkey, unnest(t) AS w FROM n) q WHERE w IN (SELECT w FROM w) GROUP BY 1), a AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE coalesce(k, 0) >= 0.4 * greatest(len(t), 1)) AS covered FROM n LEFT JOIN h USING (p_partkey)) SELECT nodes, covered, round(covered * 100 / nodes, 1) AS pct FROM a",
    "prj21_full_text": f"WITH {_T} SELECT tc_id, title, lower(concat_ws(' ', title, er, array_to_string(steps, ' '))) AS full_text FROM t",
    "prj22_enrich": f"WITH {_P}, q AS (SELECT tc_id, title, coalesce(scenario, '') AS sc, lower(title || ' ' || er) AS b FROM p) SELECT tc_id, CASE WHEN regexp_matches(b, 'invalid|fail|error|denied') THEN 'Negative' WHEN sc = 'edge' OR regexp_matches(b, 'limit|max|min|boundary|lock|timeout') THEN 'Edge Cases' WHEN regexp_matches(b, 'retry|recover|reattempt|loop') THEN 'Failure / Retry' WHEN regexp_matches(b, 'alternate|option|branch') THEN 'Alternate Paths' ELSE 'Positive' END AS scenario_type, 'Validate ' || lower(title) || ' path against knowledge graph requirements.' AS objective FROM q",
    "prj23_classify": f"WITH {_P} SELECT tc_id, {_CLASS} AS class FROM p",
    "agg16_scenario_counts": f"WITH {_P} SELECT {_CLASS} AS class, count(*) AS n FROM p GROUP BY 1",
    "prj24_negative_items": f"WITH {_P} SELECT tc_id AS item_id, er = 'an invalid pin' AS is_negative, CASE WHEN er = 'an invalid pin' THEN 'invalid' END AS cue FROM p",
    "prj25_priorities": f"{_I}, {_LINK}, k AS (SELECT item_id FROM m WHERE t IN (SELECT item_id FROM items_v)) SELECT item_id, CASE WHEN family = 'BR' OR item_id IN (FROM k) THEN 'High' ELSE 'Medium' END AS priority FROM items_v",
    "prj26_phrases": f"{cte('g_nodes', 'g_edges')} SELECT src_id, dst_id, rel_type, CASE WHEN rel_type IN ('USES', 'ASSOCIATED_WITH') AND node_type = 'DataObject' THEN 'Enter ' || name || '.' WHEN node_type = 'Action' THEN 'Perform ' || name || '.' ELSE upper(rel_type[1]) || lower(replace(rel_type[2:], '_', ' ')) || ' ' || name || '.' END AS step FROM g_edges JOIN g_nodes ON node_id = dst_id",
    "agg20_duplicates": f"WITH {_P}, q AS (SELECT tc_id, ord, first_value(tc_id) OVER (PARTITION BY feature, {_SIG} ORDER BY ord) AS f FROM p) SELECT tc_id, nullif(f, tc_id) AS duplicate_of FROM q",
    "agg20_duplication": f"WITH {_P}, q AS (SELECT tc_id, first_value(tc_id) OVER (PARTITION BY feature, {_SIG} ORDER BY ord) AS f FROM p) SELECT count(*) AS total, count(nullif(f, tc_id)) AS duplicates, round(count(nullif(f, tc_id)) * 100 / count(*), 1) AS ratio FROM q",
    "tc02_variants": f"""WITH {_P}, v AS (SELECT tc_id || '-NEG' AS tc_id, 'Negative' AS tc_type, 'Negative - ' || feature || ' with invalid inputs' AS title, array_to_string([steps[1], CASE WHEN steps[2] LIKE 'Enter %' THEN 'Enter invalid ' || steps[2][7:] ELSE steps[2] END, steps[3]], ' ') AS steps FROM p
UNION ALL SELECT tc_id || '-DEP', 'Negative', 'Negative - Missing prerequisite step for ' || feature, steps[2] || ' ' || steps[3] FROM p
UNION ALL SELECT tc_id || '-EDGE', 'Edge', 'Edge - ' || feature || ' navigation boundary & latency', 'Navigate to ' || feature || ' under latency threshold. ' || steps[2] || ' ' || steps[3] FROM p
UNION ALL SELECT tc_id || '-ALT', 'Positive', 'Positive - Alternative interaction path for ' || feature, steps[1] || ' ' || replace(replace(steps[2], 'Click ', 'Tap / Select '), 'Perform ', 'Execute alternate ') || ' ' || steps[3] FROM p
UNION ALL SELECT tc_id || '-EXC', 'Negative', 'Negative - Exception recovery during ' || feature, steps[1] || ' Trigger runtime exception during ' || feature || '. ' || steps[2] || ' ' || steps[3] FROM p)
SELECT tc_id, tc_type, title, steps FROM v QUALIFY row_number() OVER (PARTITION BY title, steps ORDER BY tc_id) = 1""",
    "win06_case_ids": f"WITH {_P} SELECT ord, 'TC-' || feature || '-' || lpad((row_number() OVER (PARTITION BY feature ORDER BY ord))::VARCHAR, 3, '0') || '-' || substr(sha256(title), 1, 4) AS tc_id FROM p",
    "agg18_grounding": f"WITH {_P}, n AS (SELECT n_name AS name FROM nation UNION ALL SELECT p_name FROM part WHERE p_partkey % 3 = 0), v AS (SELECT list(DISTINCT w) AS v FROM (SELECT unnest({_W4.format(c='name')}) AS w FROM n) q), k AS (SELECT list(DISTINCT w) FILTER (length(w) >= 4) AS k FROM (SELECT unnest({_W4.format(c='name')}) AS w FROM n UNION ALL SELECT lower(trim(name)) FROM n) q), s AS (SELECT tc_id, i - 1 AS step_no, lower(steps[i]) AS step, {_W4.format(c='steps[i]')} AS ws FROM (SELECT tc_id, steps, unnest([1, 2, 3]) AS i FROM p) q) SELECT tc_id, step_no, len(ws) = 0 OR list_has_any(ws, v) OR len(list_filter(k, lambda x: contains(step, x))) > 0 AS grounded FROM s, v, k",
    "snk13_jn16_validates": "WITH n AS (SELECT lower(trim(p_name)) AS t, min('part_' || p_partkey) AS i FROM part GROUP BY 1) SELECT DISTINCT 'P' || p_partkey AS tc_id, i AS node_id FROM part JOIN n ON t = lower(trim(p_name)) UNION SELECT 'P' || p_partkey, 'part_' || p_partkey FROM part",
    "snk15_render": f"WITH {_T} SELECT tc_id, 'Test Case: ' || tc_id || chr(10) || 'Title: ' || title || chr(10) || 'Steps:' || chr(10) || array_to_string(list_transform(steps, lambda x, i: i || '. ' || x), chr(10)) AS text FROM t",
    "win13_jn19_transitions": "SELECT * FROM (SELECT 'TC-' || conv_id AS tc_id, CAST(row_number() OVER w - 1 AS INT) AS pos, text AS step, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t WHERE next IS NOT NULL",
}
