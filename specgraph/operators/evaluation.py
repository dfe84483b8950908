"""Facts of a text and how much of them a graph retains; scores of graphs and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Verbs that make a sentence a fact.
VERBS = ("shall", "must", "should", "can", "will", "submits", "validates", "creates", "approves", "rejects", "sends", "receives", "stores", "updates", "deletes", "processes", "triggers", "contains", "includes", "requires")
_FACT = r"(?i)([A-Z][a-zA-Z0-9_\s]{1,30}?)\s+(" + "|".join(VERBS) + r")\s+(.+)"


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, fact_no, subject, predicate, object, kind) of sentences: around a known verb, else the first words of four or more."""
    s = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("pos", "raw")).withColumn("s", F.trim("raw")).filter(F.length("s") >= 8)
    words = F.filter(F.split("s", r"\s+"), lambda w: w != "")
    part = lambda k: F.regexp_extract("s", _FACT, k)
    has = part(2) != ""
    f = s.withColumn("ws", words).withColumn("has", has).filter(F.col("has") | (F.size("ws") >= 4))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    pick = lambda a, b: F.when(F.col("has"), a).otherwise(b)
    return f.select("doc_id", n.alias("fact_no"), pick(F.trim(part(1)), F.col("ws")[0]).alias("subject"), pick(F.upper(part(2)), F.lit("DESCRIBES")).alias("predicate"), pick(F.substring(F.trim(part(3)), 1, 60), F.array_join(F.slice("ws", 2, 4), " ")).alias("object"), pick(F.lit("requirement_fact"), F.lit("text_fact")).alias("kind"))


def similarity(a: Column, b: Column) -> Column:
    """1 where one name, cleaned, contains the other; else the Jaccard of their words; 0 where one is empty."""
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = clean(a), clean(b)
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / F.size(F.array_union(words(a), words(b))))


def match_facts(facts: DataFrame, nodes: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """(fact_id, status, score): verified where both ends match nodes that an edge joins, partially_verified where one does.

    Of several matching nodes the last (by ord) counts. Distinct names are compared with the distinct ends of the facts; nodes go out to every
    task, so they are to be those of one document's graph.
    """
    ends = facts.select(F.col("subject").alias("e")).unionByName(facts.select(F.col("object").alias("e"))).distinct()
    hit = ends.join(F.broadcast(nodes.select("node_id", "name", "ord")), similarity(F.col("e"), F.col("name")) >= least).groupBy("e").agg(F.max_by("node_id", "ord").alias("n"))
    j = facts.join(hit.select(F.col("e").alias("subject"), F.col("n").alias("s")), "subject", "left").join(hit.select(F.col("e").alias("object"), F.col("n").alias("o")), "object", "left")
    both = edges.select(F.col("src_id").alias("s"), F.col("dst_id").alias("o")).unionByName(edges.select(F.col("dst_id").alias("s"), F.col("src_id").alias("o"))).distinct().withColumn("joined", F.lit(True))
    j = j.join(both, ["s", "o"], "left")
    status = F.when(F.col("joined").isNotNull(), "verified").when(F.col("s").isNotNull() | F.col("o").isNotNull(), "partially_verified").otherwise("missing")
    return j.select("fact_id", status.alias("status")).withColumn("score", F.when(F.col("status") == "verified", 1.0).when(F.col("status") == "partially_verified", 0.5).otherwise(0.0))


def retention(matched: DataFrame) -> DataFrame:
    """One row: facts, recall, precision and F1 of retention, 4 decimals."""
    a = matched.agg(F.count("*").alias("facts"), F.sum("score").alias("s"), F.count_if(F.col("status") == "verified").alias("v"), F.count_if(F.col("status") == "partially_verified").alias("p"))
    r, q = F.col("s") / F.col("facts"), (F.col("v") + 0.5 * F.col("p")) / F.col("facts")
    return a.select("facts", F.round(r, 4).alias("recall"), F.round(q, 4).alias("precision"), F.round(F.when(r + q > 0, 2 * r * q / (r + q)).otherwise(0.0), 4).alias("f1"))


def sequence_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 (3 decimals; null where undefined) of the pairs (src_id, dst_id) found against the true ones."""
    f, t = found.select("src_id", "dst_id").distinct(), truth.select("src_id", "dst_id").distinct()
    c = f.intersect(t).agg(F.count("*").alias("hit")).crossJoin(f.agg(F.count("*").alias("f"))).crossJoin(t.agg(F.count("*").alias("t")))  # one row each
    p, r = F.when(F.col("f") > 0, F.col("hit") / F.col("f")), F.when(F.col("t") > 0, F.col("hit") / F.col("t"))
    return c.select(F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.when((p > 0) & (r > 0), 2 * p * r / (p + r)), 3).alias("f1"))


def relationship_quality(nodes: DataFrame, edges: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """One row: edges, dangling ones (neither end known), connectivity and share of valid types, 4 decimals."""
    ids = nodes.select("node_id").distinct()
    e = edges.join(ids.select(F.col("node_id").alias("src_id"), F.lit(1).alias("a")), "src_id", "left").join(ids.select(F.col("node_id").alias("dst_id"), F.lit(1).alias("b")), "dst_id", "left")
    n = F.count("*")
    return e.agg(n.alias("edges"), F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("dangling"), F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / n, 4).alias("connectivity"), F.round(F.count_if(F.col("rel_type").isin(*valid)) / n, 4).alias("valid_types"))


def overall(retained: Column | None, relations: Column, workflow: Column, coverage: Column) -> Column:
    """Weighted score of a graph: 35, 25, 25 and 15 per cent; without facts 10 of a full mark, 35, 35 and 20."""
    if retained is None:
        return F.round(0.10 + 0.35 * relations + 0.35 * workflow + 0.20 * coverage, 4)
    return F.round(0.35 * retained + 0.25 * relations + 0.25 * workflow + 0.15 * coverage, 4)


def node_coverage(nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: nodes, covered ones (name in any text of the corpus, by word), per cent with one decimal; nothing to cover is 100."""
    words = corpus.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("w")).distinct()
    tokens = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    n = nodes.select("node_id", F.array_distinct(tokens).alias("ts"))
    hit = n.select("node_id", F.explode("ts").alias("w")).join(words, "w", "left_semi").groupBy("node_id").agg(F.count("*").alias("k"))
    a = n.join(hit, "node_id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("k", F.lit(0)) >= 0.4 * F.greatest(F.size("ts"), F.lit(1))).alias("covered"))
    return a.select("nodes", "covered", F.when(F.col("nodes") > 0, F.round(F.col("covered") * 100 / F.col("nodes"), 1)).otherwise(100.0).alias("pct"))
