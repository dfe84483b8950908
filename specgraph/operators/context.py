"""Context of steps and items in a graph: supporting nodes, series, collapsed siblings, path checks, quality of workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O
from .analytics import components, reach

# What chunks of each kind begin with, whatever the case.
CHUNK_PATTERNS = {
    "FR": r"(?:FR|F)-?\d{3,}:",
    "NFR": r"(?:NFR|NR|NF)-?\d{3,}:",
    "BR": r"(?:BR|BRD|BU)-?\d{3,}",
    "TC": r"(?:TC|TEST|TS)-?\d{3,}:",
    "UC": r"(?:UC|USE)-?\d{3,}:",
    "US_NUMBERED": r"(?:US|UST)-?\d{3,}:",
    "US_PROSE": r"(?:User Story|Story)\s+\d+:",
    "REQ": r"(?:REQ|RQ|R)-?\d{3,}:",
    "NUMBERED_SECTION": r"\d+\.\d+(?:\.\d+)?\s+[A-Z][^\n]*\n",
}


def clean(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def supporting(steps: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step_id, node_id, rel_type, role): neighbours of steps, themselves no steps or artefacts, over relations that are no flow, dependency or document order. nodes have node_id and role."""
    out = (*O.FLOW_RELATIONS, "DEPENDS_ON", "NEXT_IN_DOCUMENT")
    e = edges.filter(~F.col("rel_type").isin(*out))
    both = e.select(F.col("src_id").alias("step_id"), F.col("dst_id").alias("node_id"), "rel_type").unionByName(e.select(F.col("dst_id").alias("step_id"), F.col("src_id").alias("node_id"), "rel_type"))
    s = steps.select(F.col("node_id").alias("step_id")).distinct()
    return both.join(s, "step_id", "left_semi").join(s.withColumnRenamed("step_id", "node_id"), "node_id", "left_anti").join(nodes.select("node_id", "role").filter("role != 'artifact'"), "node_id").select("step_id", "node_id", "rel_type", "role").distinct()


def without_nodes(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items that no node names as its source."""
    return items.join(nodes.select(F.col("source").alias("item_id")).distinct(), "item_id", "left_anti")


def series(items: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, series): items joined by edges between the nodes that name them as sources; the smallest item names the series."""
    src = nodes.select("node_id", "source")
    e = edges.join(src.select(F.col("node_id").alias("src_id"), F.col("source").alias("a")), "src_id").join(src.select(F.col("node_id").alias("dst_id"), F.col("source").alias("b")), "dst_id")
    pairs = e.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id")).distinct()
    return components(items.select(F.col("item_id").alias("node_id")), pairs).select(F.col("node_id").alias("item_id"), F.col("component").alias("series"))


def item_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item_id, node_id): nodes that name an item as source, and those one flow relation away from them."""
    own = nodes.select(F.col("source").alias("item_id"), "node_id")
    f = edges.filter(F.col("rel_type").isin(*O.FLOW_RELATIONS))
    both = f.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other")).unionByName(f.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("other")))
    return own.unionByName(own.join(both, "node_id").select("item_id", F.col("other").alias("node_id"))).distinct()


def collapse(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges after the members (array) of each group are replaced by its name; loops go, equal edges are kept once."""
    m = groups.select("name", F.explode("members").alias("member"))
    a, b = m.select(F.col("member").alias("src_id"), F.col("name").alias("_a")), m.select(F.col("member").alias("dst_id"), F.col("name").alias("_b"))
    e = edges.join(a, "src_id", "left").join(b, "dst_id", "left").select(F.coalesce("_a", "src_id").alias("src_id"), F.coalesce("_b", "dst_id").alias("dst_id"), "rel_type")
    return e.filter("src_id != dst_id").distinct()


def step_nodes(transitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """transitions (tc_id, pos, step, next) with src_id and dst_id: the node whose name each step equals after cleaning (the smallest id)."""
    n = nodes.groupBy(clean(F.col("name")).alias("k")).agg(F.min("node_id").alias("n")).filter("k != ''")
    t = transitions.withColumn("a", clean(F.col("step"))).withColumn("b", clean(F.col("next")))
    return t.join(n.select(F.col("k").alias("a"), F.col("n").alias("src_id")), "a", "left").join(n.select(F.col("k").alias("b"), F.col("n").alias("dst_id")), "b", "left").drop("a", "b")


def path_validity(located: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """One row: transitions whose both steps are nodes, how many of them the graph allows in up to ``hops`` steps, per cent (none: 100)."""
    r = reach(edges, hops).select("src_id", "dst_id", F.lit(True).alias("ok"))
    a = located.filter("src_id is not null and dst_id is not null").join(r, ["src_id", "dst_id"], "left").agg(F.count("*").alias("checked"), F.count("ok").alias("valid"))
    return a.select("checked", "valid", F.when(F.col("checked") > 0, F.round(F.col("valid") * 100 / F.col("checked"), 1)).otherwise(100.0).alias("pct"))


def workflow_quality(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: consecutive steps (flow, pos, node_id) that an edge joins among all, and steps without any edge."""
    t = steps.withColumn("next", F.lead("node_id").over(W.partitionBy("flow").orderBy("pos")))
    pairs = edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("next")).distinct().withColumn("ok", F.lit(True))
    trans = t.filter("next is not null").join(pairs, ["node_id", "next"], "left").agg(F.count("*").alias("transitions"), F.count("ok").alias("joined"))
    ends = edges.select(F.col("src_id").alias("node_id")).unionByName(edges.select(F.col("dst_id").alias("node_id"))).distinct()
    orphan = steps.select("node_id").distinct().join(ends, "node_id", "left_anti").agg(F.count("*").alias("orphans"))
    return trans.crossJoin(orphan).withColumn("accuracy", F.when(F.col("transitions") > 0, F.round(F.col("joined") / F.col("transitions"), 4)).otherwise(0.0))  # one row each


def chunk_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, n): starts of chunks of each kind in a text."""
    each = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(f"(?is){p}")).alias("n")) for k, p in CHUNK_PATTERNS.items()])
    return docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.pattern", "x.n").filter("n > 0")


def chunk_strategy(docs: DataFrame) -> DataFrame:
    """(doc_id, patterns, strategy): how many chunk starts a text has, and whether it is cut at these (pattern-based) or by size (semantic-fallback)."""
    n = chunk_patterns(docs).groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("patterns"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("patterns", F.lit(0)).cast("bigint").alias("patterns"), F.when(F.col("patterns") > 0, "pattern-based").otherwise("semantic-fallback").alias("strategy"))


def labelled_items(lines: DataFrame) -> DataFrame:
    """(doc_id, item_id, title, content) of lines (doc_id, line_no, line): from one ``Title:`` line to the next; ids count from GEN-001 in each document."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    l = lines.withColumn("title", F.nullif(F.regexp_extract("line", r"(?is)^\s*title\s*:\s*(.*)$", 1), F.lit(""))).withColumn("span", F.count("title").over(w)).filter("span > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return l.groupBy("doc_id", "span").agg(F.max("title").alias("title"), body.alias("content")).select("doc_id", F.concat(F.lit("GEN-"), F.lpad(F.col("span").cast("string"), 3, "0")).alias("item_id"), "title", "content")


def without_repeats(steps: DataFrame) -> DataFrame:
    """Steps (flow, pos, name) without those that repeat the one before."""
    return steps.withColumn("_p", F.lag("name").over(W.partitionBy("flow").orderBy("pos"))).filter("_p is null or _p != name").drop("_p")


def item_checks(items: DataFrame) -> DataFrame:
    """Items (doc_id, item_id, family, content, native) with reasons for review: repeated id, foreign family, short content, odd id."""
    again = F.count("*").over(W.partitionBy("doc_id", "item_id")) > 1
    odd = ~F.col("item_id").rlike(r"(?i)^(?:[A-Z]{1,4}-?\d{3,}|[A-Z]{2,4}[_-](?:[A-Za-z]+[_-])+\d+)$")
    reasons = F.array_compact(F.array(F.when(again, "duplicate id"), F.when(~F.col("native"), "foreign family"), F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) < 10, "short content"), F.when(odd & ~F.col("item_id").startswith("GEN-"), "no known id")))
    return items.withColumn("reasons", reasons)
