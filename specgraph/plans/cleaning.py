"""Queries: cleaning of an extracted graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions.text import normalize_id, normalize_relation
from ..operators import cleaning as C
from .fixtures import cte, load


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _norm(c: str) -> str:
    return f"regexp_replace(translate(lower({c}), '- ', '__'), '^\\s+|\\s+$', '', 'g')"


_CLEAN = "replace(replace(upper(trim(rel_type)), ' ', '_'), '-', '_')"
_SYN = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in O.RELATION_SYNONYMS.items())
_REL = f"""CASE WHEN {_CLEAN} IN ({_list(O.RELATIONS)}) THEN {_CLEAN} WHEN {_CLEAN} IN ({_list(O.RELATION_SYNONYMS)}) THEN CASE {_CLEAN} {_SYN} END
WHEN {_CLEAN} IN ({_list(O.BLOCKED_RELATIONS)}) THEN 'RELATED_TO' ELSE coalesce(nullif(regexp_replace({_CLEAN}, '[^A-Z0-9_]', '', 'g'), ''), 'RELATED_TO') END"""
_PRIO = "CASE node_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.TYPE_PRIORITY.items()) + " ELSE 0 END"

_DEDUP_NODES = f"dn0 AS (SELECT {_norm('node_id')} AS node_id, node_type, name, description, source, ord, {_PRIO} AS pr FROM raw_nodes), dn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY node_id) AS occ, row_number() OVER (PARTITION BY node_id ORDER BY pr DESC, ord) AS rn FROM dn0) t WHERE rn = 1)"
_DEDUP_EDGES = f"""de0 AS (SELECT {_norm('src_id')} AS src_id, {_norm('dst_id')} AS dst_id, rel_type, source, ord FROM raw_edges),
de1 AS (SELECT *, first_value(src_id) OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id), rel_type ORDER BY ord) AS f, count(*) OVER (PARTITION BY src_id, dst_id, rel_type) AS occ, row_number() OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY ord) AS rn FROM de0),
de AS (SELECT src_id, dst_id, rel_type, source, ord, occ FROM de1 WHERE rn = 1 AND f = src_id)"""
_CONFLICTS = """tc0 AS (SELECT a.node_id, a.ord, a.node_type, a.pr, (SELECT arg_max(b.node_type, b.pr * 100000000000 - b.ord) FROM dn0 b WHERE b.node_id = a.node_id AND b.ord < a.ord) AS held FROM dn0 a),
tc AS (SELECT node_id, ord, node_type, held, pr, CASE held """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.TYPE_PRIORITY.items()) + """ ELSE 0 END AS hp FROM tc0 WHERE held IS NOT NULL AND held <> node_type)"""
_CHECKED = f"""gn AS (SELECT * FROM dn WHERE node_type IN ({_list(O.NODE_TYPES)})),
ce0 AS (SELECT de.src_id, de.dst_id, {_REL.replace('rel_type', 'de.rel_type')} AS rel_type, de.ord, s.node_id AS s, t.node_id AS t, s.node_type AS st, t.node_type AS tt FROM de LEFT JOIN gn s ON s.node_id = de.src_id LEFT JOIN gn t ON t.node_id = de.dst_id),
ce1 AS (SELECT *, concat_ws('; ', CASE WHEN s IS NULL THEN 'source not found' END, CASE WHEN t IS NULL THEN 'target not found' END,
CASE WHEN s IS NOT NULL AND t IS NOT NULL AND rel_type IN ({_list(O.ACTOR_TARGET_FORBIDDEN)}) AND tt = 'Actor' THEN 'actor as target' END,
CASE WHEN s IS NOT NULL AND t IS NOT NULL AND rel_type = 'AUTHENTICATES' AND st NOT IN ({_list(O.AUTHENTICATES_SOURCES)}) THEN 'source cannot authenticate' END,
CASE WHEN s IS NOT NULL AND t IS NOT NULL AND rel_type = 'SHOWS' AND st = 'Actor' THEN 'actor as source' END) AS r FROM ce0),
ce AS (SELECT src_id, dst_id, rel_type, ord, CASE WHEN r = '' AND rel_type NOT IN ({_list(O.SYMMETRIC_RELATIONS)}) AND EXISTS (SELECT 1 FROM ce1 o WHERE o.r = '' AND o.src_id = c.dst_id AND o.dst_id = c.src_id AND o.rel_type = c.rel_type) THEN 'contradicts its reverse' ELSE r END AS reasons FROM ce1 c)"""
_SCORED = """sn AS (SELECT dn.*, greatest(0, least(1, round(CAST(0.5 + CASE WHEN occ <= 1 THEN 0 WHEN occ = 2 THEN 0.15 ELSE 0.25 END + CASE WHEN coalesce(description, '') <> '' THEN 0.1 ELSE 0 END - CASE WHEN node_id IN (SELECT node_id FROM tc) THEN 0.2 ELSE 0 END AS DECIMAL(12,6)), 2))) AS confidence FROM dn),
se AS (SELECT de.*, greatest(0, least(1, round(CAST(0.5 + CASE WHEN de.occ <= 1 THEN 0 WHEN de.occ = 2 THEN 0.15 ELSE 0.25 END + ((coalesce(CAST(a.confidence AS DOUBLE), 0.5) + coalesce(CAST(b.confidence AS DOUBLE), 0.5)) / 2 - 0.5) * 0.3
- CASE WHEN x.f IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN de.source IN ('REQ-1', 'REQ-2') THEN 0.15 ELSE 0 END AS DECIMAL(12,6)), 2))) AS confidence
FROM de LEFT JOIN sn a ON a.node_id = de.src_id LEFT JOIN sn b ON b.node_id = de.dst_id LEFT JOIN (SELECT DISTINCT src_id, dst_id, rel_type, f FROM de1 WHERE f <> src_id) x ON x.src_id = de.dst_id AND x.dst_id = de.src_id AND x.rel_type = de.rel_type)"""


def _dedup(s, d, edges="raw_edges"):
    return C.dedup_nodes(load(s, d, "raw_nodes")), C.dedup_edges(load(s, d, edges))


def _scored(s, d, edges="raw_edges"):
    raw_n, raw_e = load(s, d, "raw_nodes"), load(s, d, edges)
    n = C.score_nodes(C.dedup_nodes(raw_n), C.type_conflicts(raw_n))
    linked = s.createDataFrame([("REQ-1",), ("REQ-2",)], "source string")
    return n, C.score_edges(C.dedup_edges(raw_e), n, C.direction_conflicts(raw_e), linked)


def _checked(s, d, edges="raw_edges"):
    n, e = _dedup(s, d, edges)
    return C.check_edges(e, C.check_nodes(n).filter(F.size("reasons") == 0))


QUERIES = {
    "prj01_normalize_id": lambda s, d: load(s, d, "raw_nodes").select("ord", normalize_id(F.col("node_id")).alias("node_id")),
    "prj02_normalize_relation": lambda s, d: load(s, d, "raw_edges").select("ord", "rel_type", normalize_relation(F.col("rel_type")).alias("normal")),
    "win01_agg02_dedup_nodes": lambda s, d: _dedup(s, d)[0].select("node_id", "node_type", "description", "source", "ord", "occ"),
    "win02_type_conflicts": lambda s, d: C.type_conflicts(load(s, d, "raw_nodes")),
    "win03_agg03_dedup_edges": lambda s, d: _dedup(s, d)[1].select("src_id", "dst_id", "rel_type", "source", "ord", "occ"),
    "win03_direction_conflicts": lambda s, d: C.direction_conflicts(load(s, d, "raw_edges")),
    "prj04_check_nodes": lambda s, d: C.check_nodes(_dedup(s, d)[0]).select("node_id", F.concat_ws("; ", "reasons").alias("reasons")),
    "prj05_prj06_jn15_check_edges": lambda s, d: _checked(s, d).select("src_id", "dst_id", "rel_type", "ord", F.concat_ws("; ", "reasons").alias("reasons")),
    "prj06_validation_counts": lambda s, d: _checked(s, d).groupBy(F.concat_ws("; ", "reasons").alias("reasons")).agg(F.count("*").alias("n")),
    "jn11_node_confidence": lambda s, d: _scored(s, d)[0].select("node_id", "confidence"),
    "jn11_edge_confidence": lambda s, d: _scored(s, d)[1].select("src_id", "dst_id", "rel_type", "confidence"),
    "agg06_confidence_summary": lambda s, d: C.confidence_summary(*_scored(s, d)),
    # The same over every row of lineitem; the SQL twins read a part of them.
}

_N, _E, _B = cte("raw_nodes"), cte("raw_edges"), cte("raw_nodes", "raw_edges")
SQL = {
    "prj01_normalize_id": f"{_N} SELECT ord, {_norm('node_id')} AS node_id FROM raw_nodes",
    "prj02_normalize_relation": f"{_E} SELECT ord, rel_type, {_REL} AS normal FROM raw_edges",
    "win01_agg02_dedup_nodes": f"{_N}, {_DEDUP_NODES} SELECT node_id, node_type, description, source, ord, occ FROM dn",
    "win02_type_conflicts": f"{_N}, {_DEDUP_NODES}, {_CONFLICTS} SELECT node_id, ord, CASE WHEN pr > hp THEN node_type ELSE held END AS kept_type, CASE WHEN pr > hp THEN held ELSE node_type END AS ignored_type FROM tc",
    "win03_agg03_dedup_edges": f"{_E}, {_DEDUP_EDGES} SELECT * FROM de",
    "win03_direction_conflicts": f"{_E}, {_DEDUP_EDGES} SELECT src_id, dst_id, rel_type, ord FROM de1 WHERE f <> src_id",
    "prj04_check_nodes": f"{_N}, {_DEDUP_NODES} SELECT node_id, CASE WHEN node_type IN ({_list(O.NODE_TYPES)}) THEN '' ELSE 'unknown node type: ' || node_type END AS reasons FROM dn",
    "prj05_prj06_jn15_check_edges": f"{_B}, {_DEDUP_NODES}, {_DEDUP_EDGES}, {_CHECKED} SELECT * FROM ce",
    "prj06_validation_counts": f"{_B}, {_DEDUP_NODES}, {_DEDUP_EDGES}, {_CHECKED} SELECT reasons, count(*) AS n FROM ce GROUP BY reasons",
    "jn11_node_confidence": f"{_B}, {_DEDUP_NODES}, {_CONFLICTS}, {_DEDUP_EDGES}, {_SCORED} SELECT node_id, CAST(confidence AS DOUBLE) AS confidence FROM sn",
    "jn11_edge_confidence": f"{_B}, {_DEDUP_NODES}, {_CONFLICTS}, {_DEDUP_EDGES}, {_SCORED} SELECT src_id, dst_id, rel_type, CAST(confidence AS DOUBLE) AS confidence FROM se",
    "agg06_confidence_summary": f"{_B}, {_DEDUP_NODES}, {_CONFLICTS}, {_DEDUP_EDGES}, {_SCORED} SELECT (SELECT count(*) FROM sn) AS total_nodes, (SELECT count(*) FROM sn WHERE confidence < 0.5) AS low_nodes, (SELECT CAST(round(sum(CAST(confidence AS DECIMAL(9,4))) / count(*), 2) AS DOUBLE) FROM sn) AS avg_nodes, count(*) AS total_edges, count(*) FILTER (WHERE confidence < 0.5) AS low_edges, CAST(round(sum(CAST(confidence AS DECIMAL(9,4))) / count(*), 2) AS DOUBLE) AS avg_edges FROM se",
}
