"""Reports on graphs and test cases: why nodes stand apart, flags on structure, coverage of facts and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import ontology as O
from . import analytics

# Types that support a flow and are no step of one.
SUPPORT_TYPES = ("TestCase", "Attribute", "DataObject", "SystemComponent", "NonFunctionalRequirement", "BusinessRule", "Constraint")
# Scenarios, and which are expected where nothing is known.
SCENARIOS = ("positive", "negative", "edge", "alternate", "failure_retry")
# Words that tell nothing, in any text and in names; words too common to be the core of a name.
STOP_WORDS = ("the", "and", "for", "are", "not", "has", "with", "user", "that", "this", "from", "but", "can", "all", "was", "they", "when", "have", "will", "been", "each", "than", "then")
NAME_NOISE = ("message", "feature", "portal", "system")
CORE_NOISE = ("feature", "process", "functionality", "table", "page")


def _flow_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id of nodes that are part of a flow."""
    flow = analytics.flow_edges(nodes if "seq" in nodes.columns else nodes.withColumn("seq", F.lit(None).cast("int")), edges)
    return flow.select(F.col("src_id").alias("node_id")).unionByName(flow.select(F.col("dst_id").alias("node_id"))).distinct()


def isolation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, node_type, reason) of nodes outside any flow: no relationships, supporting type, or no flow relation."""
    known = analytics.induced(edges, nodes)
    ends = known.select(F.col("src_id").alias("node_id")).unionByName(known.select(F.col("dst_id").alias("node_id"))).distinct().withColumn("linked", F.lit(True))
    apart = nodes.select("node_id", "node_type").join(_flow_ends(nodes, edges), "node_id", "left_anti").join(ends, "node_id", "left")
    reason = F.when(F.col("linked").isNull(), "no relationships").when(F.col("node_type").isin(*SUPPORT_TYPES), "supporting type").otherwise("no flow relation")
    return apart.select("node_id", "node_type", reason.alias("reason"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, isolated (outside any flow) and what that says of the graph."""
    apart = nodes.select("node_id").join(_flow_ends(nodes, edges), "node_id", "left_anti").agg(F.count("*").alias("isolated"))
    share = F.col("isolated") / F.col("nodes")
    word = F.when(F.col("nodes") == 0, "Empty Graph").when(F.col("isolated") == 0, "Excellent").when(share < 0.15, "Good").when(share < 0.35, "Fair").otherwise("Needs Review")
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(apart).withColumn("health", word)  # one row each


def structure(nodes: DataFrame, edges: DataFrame, empty_items: DataFrame | None = None, hub_share: float = 0.15) -> DataFrame:
    """(flag, status, detail): PASS or WARN on isolated nodes, fragmentation, hubs and items without entities."""
    degree = analytics.degrees(nodes, edges)
    lone = degree.agg(F.count_if(F.col("degree") == 0).alias("n"))
    sizes = analytics.components(nodes, edges).groupBy("component").count()
    parts = sizes.agg(F.count("*").alias("parts"), F.round(F.max("count") * 100 / F.sum("count"), 1).alias("pct"))
    hub = analytics.hubs(degree, hub_share).agg(F.count("*").alias("n"), F.max_by("node_id", F.struct("share", "node_id")).alias("top"), F.round(F.max("share") * 100, 1).alias("pct"))

    def flag(df: DataFrame, name: str, bad: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("flag"), F.when(bad, "WARN").otherwise("PASS").alias("status"), detail.alias("detail"))

    out = [
        flag(lone, "isolated nodes", F.col("n") > 0, F.format_string("%d", F.col("n"))), flag(parts, "fragmentation", F.coalesce(F.col("pct"), F.lit(100.0)) < 90, F.format_string("%d components, %s%% in the largest", F.col("parts"), F.coalesce("pct", F.lit(0.0)))),
        flag(hub, "hubs", F.col("n") > 0, F.when(F.col("n") > 0, F.format_string("%s touches %s%%", F.col("top"), F.col("pct"))).otherwise("")),
    ]
    if empty_items is not None:
        out.append(flag(empty_items.agg(F.count("*").alias("n")), "items without entities", F.col("n") > 0, F.format_string("%d", F.col("n"))))
    return reduce(DataFrame.unionByName, out)


def _either_in(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def facts_on_edges(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_id, matched): whether an edge's ends contain the fact's two, or are contained in them, whatever the case.

    Which ends of edges fit which ends of facts is found on distinct names first; the pairs that fit are then looked up among the edges.
    """
    f = facts.select("fact_id", F.lower("subject").alias("s"), F.lower("object").alias("o"))
    e = edges.select(F.lower("src_id").alias("a"), F.lower("dst_id").alias("b")).distinct()
    fit = lambda x, y: x.distinct().join(y.distinct(), _either_in(F.col(x.columns[0]), F.col(y.columns[0])))
    s, o = analytics.cut(fit(f.select("s"), e.select("a")), "fits"), analytics.cut(fit(f.select("o"), e.select("b")), "fits")
    hit = f.filter("s is not null and o is not null").join(s, "s").join(e, "a").join(o, ["o", "b"], "left_semi").select("fact_id", F.lit(True).alias("hit")).distinct()
    return f.join(hit, "fact_id", "left").select("fact_id", F.coalesce("hit", F.lit(False)).alias("matched"))


def entity_coverage(facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, orphans, entities of the facts, those whose name a node's contains or is contained in, and the score, 4 decimals."""
    x = facts.select(F.lower("subject").alias("e")).unionByName(facts.select(F.lower("object").alias("e"))).filter("e != ''").distinct()
    names = nodes.select(F.lower(F.coalesce("name", "node_id")).alias("g")).distinct()
    c = x.join(names, _either_in(F.col("e"), F.col("g")), "left_semi").agg(F.count("*").alias("covered")).crossJoin(x.agg(F.count("*").alias("entities")))
    ends = edges.select(F.col("src_id").alias("node_id")).unionByName(edges.select(F.col("dst_id").alias("node_id"))).distinct()
    lone = nodes.select("node_id").distinct().join(ends, "node_id", "left_anti").agg(F.count("*").alias("orphans"))
    one = nodes.agg(F.count("*").alias("nodes")).crossJoin(lone).crossJoin(c)  # one row each
    one = one.withColumn("orphan_ratio", F.when(F.col("nodes") > 0, F.round(F.col("orphans") / F.col("nodes"), 4)).otherwise(0.0))
    one = one.withColumn("raw_coverage", F.when(F.col("entities") > 0, F.round(F.col("covered") / F.col("entities"), 4)).otherwise(1.0))
    score = F.when(F.col("nodes") > 0, F.round(F.col("raw_coverage") * (1 - 0.5 * F.col("orphan_ratio")), 4)).otherwise(0.0)
    return one.select("nodes", "orphans", "orphan_ratio", "entities", "covered", "raw_coverage", score.alias("score"))


def generation_summary(cases: DataFrame) -> DataFrame:
    """(scenario, cases, fallbacks, gaps) of generated test cases (scenario, fallback, gap)."""
    return cases.groupBy("scenario").agg(F.count("*").alias("cases"), F.count_if("fallback").alias("fallbacks"), F.count_if("gap").alias("gaps"))


def mean_scores(judged: DataFrame, default: float = 8.5) -> DataFrame:
    """One row: each column's mean over scores from 1 to 10, 2 decimals; ``default`` where none could be read."""
    return judged.agg(*[F.coalesce(F.round(F.avg(F.when(F.col(c).between(1, 10), F.col(c))), 2), F.lit(default)).alias(c) for c in judged.columns])


def scenario_score(cases: DataFrame, contract: DataFrame | None = None) -> DataFrame:
    """(scenario, cases, expected, score_pct): a row per scenario; the score is the share of expected ones that have a case.

    Without a contract all but failure_retry are expected; with one, those that any feature asks for.
    """
    spark = cases.sparkSession
    kinds = spark.createDataFrame([(s, s != "failure_retry") for s in SCENARIOS], "scenario string, usual boolean")
    out = kinds.join(cases.groupBy("scenario").agg(F.count("*").alias("cases")), "scenario", "left")
    if contract is None:
        out = out.withColumn("expected", F.col("usual"))
    else:
        asked = contract.agg(*[F.coalesce(F.bool_or(s), F.lit(s == "positive")).alias(s) for s in SCENARIOS])
        asked = asked.select(F.explode(F.create_map(*[x for s in SCENARIOS for x in (F.lit(s), F.col(s))])).alias("scenario", "expected"))
        out = out.join(asked, "scenario")
    out = out.select("scenario", F.coalesce("cases", F.lit(0)).alias("cases"), "expected")
    every = W.partitionBy()  # five rows
    return out.withColumn("score_pct", F.round(F.count_if(F.col("expected") & (F.col("cases") > 0)).over(every) * 100 / F.greatest(F.count_if("expected").over(every), F.lit(1)), 1))


def workflow_accuracy(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: share of step nodes on flow relations (may exceed 1), share of consecutive steps (feature, pos, node_id) that an edge joins, their mean, and orphans.

    Step nodes are those in sequence or of a step's type, else all. Without features of two steps or more the second share is that of flow relations to
    steps, at most 1, or, without those, of nodes in sequence.
    """
    kinds = [t.upper() for role in ("workflow_step", "workflow_state") for t in O.NODE_ROLES[role]]
    seq = F.col("seq").isNotNull() if "seq" in nodes.columns else F.lit(False)
    flow = edges.filter(F.col("rel_type").isin(*O.FLOW_RELATIONS, "NEXT"))
    ends = flow.select(F.col("src_id").alias("n")).unionByName(flow.select(F.col("dst_id").alias("n"))).distinct()
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(seq | F.upper("node_type").isin(kinds)).alias("marked"), F.count_if(seq).alias("sequenced"))
    t = steps.withColumn("next", F.lead("node_id").over(W.partitionBy("feature").orderBy("pos")))
    pairs = edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("next")).distinct().withColumn("ok", F.lit(True))
    t = t.join(pairs, ["node_id", "next"], "left").agg(F.count("*").alias("feature_steps"), F.count("ok").alias("valid"))
    one = n.crossJoin(flow.agg(F.count("*").alias("flow_edges"))).crossJoin(ends.agg(F.count("*").alias("connected"))).crossJoin(t).crossJoin(steps.agg(F.count_distinct("feature").alias("features")))  # one row each
    one = one.withColumn("steps", F.when(F.col("marked") > 0, F.col("marked")).otherwise(F.col("nodes")))
    at_least = lambda c: F.greatest(c, F.lit(1))
    cover = F.round(F.col("connected") / at_least(F.col("steps")), 4)
    moves = F.when(F.col("feature_steps") > 1, F.col("valid") / at_least(F.col("feature_steps") - F.col("features"))).when(F.col("flow_edges") > 0, F.least(F.lit(1.0), F.col("flow_edges") / at_least(F.col("steps")))).otherwise(F.col("sequenced") / at_least(F.col("nodes")))
    one = one.withColumn("step_coverage", cover).withColumn("transition_accuracy", F.round(moves, 4))
    return one.select("steps", "flow_edges", "features", "feature_steps", "valid", "step_coverage", "transition_accuracy", F.round(0.5 * F.col("step_coverage") + 0.5 * F.col("transition_accuracy"), 4).alias("sequence_accuracy"), F.greatest(F.col("steps") - F.col("connected"), F.lit(0)).alias("orphans"))


def _plain(c: Column) -> Column:
    """Lower case without quotes and backslashes, runs of white space as one space."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\"'\\\\]", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def _passages(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(piece) of ``wanted``, which have three characters or more, that stand anywhere in a text (column t).

    Every place of a text is asked for its three characters first, then, once for each length that a piece with these may have, for the piece itself:
    as many rows as the texts have characters, times those lengths, however many pieces begin alike or texts repeat.
    """
    begun = wanted.groupBy(F.substring("piece", 1, 3).alias("begin")).agg(F.collect_set(F.length("piece")).alias("lengths"))
    most = wanted.agg(F.max(F.length("piece")).alias("most"))
    long = texts.filter(F.length("t") >= 3).crossJoin(F.broadcast(most))  # one row
    places = long.select("t", "most", F.explode(F.sequence(F.lit(1), F.length("t") - 2)).alias("at")).select(F.col("t").substr(F.col("at"), F.col("most")).alias("rest")).distinct()
    met = places.withColumn("begin", F.substring("rest", 1, 3)).join(begun, "begin").select("rest", F.explode("lengths").alias("n"))
    found = met.filter(F.length("rest") >= F.col("n")).select(F.col("rest").substr(F.lit(1), F.col("n")).alias("piece")).distinct()
    return wanted.join(found, "piece", "left_semi")


def covered_nodes(nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(node_id, covered): whether the texts of the corpus mention a node: one of them by its whole name or id, by these without
    common beginnings and ends or by the stem of one of its core words; or all of them together by two fifths of its words.
    """
    texts = analytics.cut(corpus.select(_plain(F.col("text")).alias("t")).distinct(), "texts")
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit("([a-z0-9]+)"), F.lit(1))).alias("piece")).distinct()
    words = words.filter((F.length("piece") >= 3) & ~F.col("piece").isin(*STOP_WORDS, *NAME_NOISE, "app"))
    name, node = _plain(F.col("name")), _plain(F.col("node_id"))
    begin = r"^(feature_|system_|app_)"
    short = F.regexp_replace(F.regexp_replace(name, begin, ""), r"(\s+message|\s+portal|\s+app)$", "")
    code = F.regexp_replace(F.regexp_replace(node, begin, ""), "(_message|_portal|_app)$", "")
    tokens = F.filter(F.array_distinct(F.concat(F.split(short, r"[_\-\s]+"), F.split(code, r"[_\-\s]+"))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS, *NAME_NOISE))
    stems = F.transform(F.filter("tokens", lambda w: (F.length(w) >= 4) & ~w.isin(*CORE_NOISE)), lambda w: F.substring(w, 1, 4))
    # Nodes told apart by id and name; ``times`` counts rows that repeat both.
    each = nodes.groupBy("node_id", "name").agg(F.count("*").alias("times")).select("node_id", "name", "times", F.array(name, node, short, code).alias("whole"), tokens.alias("tokens"))
    part = lambda pieces, word: F.transform(pieces, lambda x: F.struct(x.alias("piece"), F.lit(word).alias("word")))
    parts = F.concat(part(F.array_distinct(F.concat(F.filter("whole", lambda x: F.length(x) >= 3), stems)), False), part(F.col("tokens"), True))
    asked = analytics.cut(each.select("node_id", "name", "times", F.size("tokens").alias("n"), F.explode_outer(parts).alias("p")).select("node_id", "name", "times", "n", "p.piece", "p.word"), "pieces")
    told = _passages(texts, asked.filter("NOT word").select("piece").distinct()).withColumn("word", F.lit(False))
    hits = told.unionByName(words.withColumn("word", F.lit(True))).withColumn("hit", F.lit(1))
    found = asked.join(hits, ["piece", "word"], "left").groupBy("node_id", "name", "times").agg(F.count_if(F.col("word") & F.col("hit").isNotNull()).alias("words"), F.max("n").alias("n"), F.count_if(~F.col("word") & F.col("hit").isNotNull()).alias("whole"))
    covered = (F.col("whole") > 0) | ((F.col("n") > 0) & (F.col("words") >= 0.4 * F.col("n")))
    return found.select("node_id", covered.alias("covered"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_")).drop("_")


def coverage(nodes: DataFrame, corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges, those covered (an edge by both ends), per cent with one decimal; nothing to cover is 100."""
    c = analytics.cut(covered_nodes(nodes, corpus), "covered")
    known = analytics.induced(edges, c)
    sure = analytics.induced(known, c.filter("covered")).agg(F.count("*").alias("covered_edges"))
    one = c.agg(F.count("*").alias("nodes"), F.count_if("covered").alias("covered_nodes")).crossJoin(known.agg(F.count("*").alias("edges"))).crossJoin(sure)  # one row each
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) * 100 / F.col(b), 1)).otherwise(100.0)
    return one.select("nodes", "covered_nodes", pct("covered_nodes", "nodes").alias("node_pct"), "edges", "covered_edges", pct("covered_edges", "edges").alias("edge_pct"))


def grounded(cases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Test cases (tc_id, entities) all of whose entities are among the tokens, whatever the case; one without entities stays."""
    asked = cases.select("tc_id", F.explode("entities").alias("e")).select("tc_id", F.lower(F.trim("e")).alias("token")).distinct()
    bad = asked.join(tokens.select(F.lower("token").alias("token")).distinct(), "token", "left_anti").select("tc_id").distinct()
    return cases.join(bad, "tc_id", "left_anti")


def accepted(proposals: DataFrame, nodes: DataFrame, relations: tuple[str, ...] = O.RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(proposed edges of an allowed relation, with a source, to a known node; the others with the reason)."""
    ids = nodes.select(F.col("node_id").alias("dst_id")).distinct().withColumn("known", F.lit(True))
    reason = F.when(~F.col("rel_type").isin(*relations), "relation is not allowed").when(F.trim(F.coalesce("src_id", F.lit(""))) == "", "no source").when(F.col("known").isNull(), "target is unknown")
    j = proposals.join(ids, "dst_id", "left").withColumn("reason", reason)
    return j.filter("reason is null").select(*proposals.columns), j.filter("reason is not null").select(*proposals.columns, "reason")


def plan_statistics(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """One row: new and known nodes and edges of a graph to be merged into another."""
    triple = ["src_id", "dst_id", "rel_type"]

    def two(old: DataFrame, new: DataFrame, keys: list[str], name: str) -> DataFrame:
        mark = old.select(*keys).distinct().withColumn("was", F.lit(True))
        return new.select(*keys).distinct().join(mark, keys, "left").agg(F.count_if(F.col("was").isNull()).alias(f"new_{name}"), F.count("was").alias(f"known_{name}"))

    return two(old_nodes, new_nodes, ["node_id"], "nodes").crossJoin(two(old_edges, new_edges, triple, "edges"))  # one row each


def joined_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, pos, node_id, next, joined): consecutive steps and whether an edge leads from one to the other."""
    pairs = edges.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("next")).distinct().withColumn("joined", F.lit(True))
    t = steps.withColumn("next", F.lead("node_id").over(W.partitionBy("feature").orderBy("pos"))).filter("next is not null")
    return t.join(pairs, ["node_id", "next"], "left").select("feature", "pos", "node_id", "next", F.coalesce("joined", F.lit(False)).alias("joined"))


def verifies(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tc_id, node_id): items that test cases (tc_id, source_items) come from and that are nodes."""
    return cases.select("tc_id", F.explode("source_items").alias("node_id")).distinct().join(nodes.select("node_id").distinct(), "node_id", "left_semi").select("tc_id", "node_id")


def unresolved(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tc_id, token): names in test cases (tc_id, graph_nodes) that no node has as id or name, whatever the case."""
    known = nodes.select(F.lower(F.trim("node_id")).alias("token")).unionByName(nodes.select(F.lower(F.trim("name")).alias("token"))).distinct()
    return cases.select("tc_id", F.explode("graph_nodes").alias("token")).select("tc_id", F.lower(F.trim("token")).alias("token")).filter("token != ''").distinct().join(known, "token", "left_anti").select("tc_id", "token")


def contained_nodes(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(step_id, node_id) of steps (step_id, text) that contain a node's name, letters and digits alone counting; of several the last by ord.

    Distinct texts meet distinct names; both are to be those of one document.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    names = nodes.groupBy(bare(F.coalesce("name", "node_id")).alias("k")).agg(F.max(F.struct("ord", "node_id")).alias("n")).filter("k != ''")
    texts = steps.select("step_id", bare(F.col("text")).alias("t"))
    hit = texts.select("t").distinct().join(names, F.contains(F.col("t"), F.col("k"))).groupBy("t").agg(F.max("n").alias("n"))
    return texts.join(hit, "t").select("step_id", F.col("n.node_id").alias("node_id"))


# Signs of a test case that is to fail, and types of nodes that support a step.
FAILING = ("NEG", "FAIL", "EDGE", "NEGATIVE", "ERROR", "INVALID")
SUPPORTING = ("BusinessRule", "Condition", "Constraint", "DataObject", "SystemComponent")


def failure_trace(cases: DataFrame, validates: DataFrame, dominators: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tc_id, target, kind, node_id): what must have happened before the nodes that failing test cases check.

    ``cases``: tc_id, name, tc_type, of which those that look like failures are traced; ``validates``: tc_id, node_id; ``dominators``: node_id, dominator.
    kind is upstream for the target's other dominators, supporting for rules, conditions, data and components that an edge joins to it or to one of them.
    """
    looks = F.upper(F.concat_ws(" ", "tc_id", "name", "tc_type"))
    asked = cases.filter(looks.rlike("|".join(FAILING))).select("tc_id").distinct().join(validates, "tc_id").select("tc_id", F.col("node_id").alias("target")).distinct()
    inner = asked.join(dominators.select(F.col("node_id").alias("target"), F.col("dominator").alias("node_id")), "target").select("tc_id", "target", "node_id")
    inner = inner.unionByName(asked.withColumn("node_id", F.col("target"))).distinct()
    inner = analytics.cut(inner, "before")
    kinds = nodes.filter(F.col("node_type").isin(*SUPPORTING)).select("node_id").distinct()
    e = edges.select("src_id", "dst_id").distinct()
    both = e.select(F.col("src_id").alias("node_id"), F.col("dst_id").alias("other")).unionByName(e.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("other")))
    near = inner.join(both, "node_id").select("tc_id", "target", F.col("other").alias("node_id")).distinct().join(kinds, "node_id", "left_semi").join(inner, ["tc_id", "target", "node_id"], "left_anti")
    up = inner.filter("node_id != target").select("tc_id", "target", F.lit("upstream").alias("kind"), "node_id")
    return up.unionByName(near.select("tc_id", "target", F.lit("supporting").alias("kind"), "node_id"))


def catalog(nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, name, source) of entities that a source item is known for, without the items' own nodes."""
    kept = nodes.filter(~F.col("node_id").startswith("requirement_") & (F.coalesce("source", F.lit("")) != ""))
    return kept.select("node_id", F.coalesce("node_type", F.lit("?")).alias("node_type"), F.coalesce("name", "node_id").alias("name"), "source")


def catalog_lines(entries: DataFrame, item: str, most_chars: int) -> DataFrame:
    """(node_id, line) of a catalog's entries from other items than ``item``, by id, as many as a budget of characters admits; the first always.

    A line has eleven characters or more, so that a fixed number of entries is enough to fill the budget.
    """
    line = F.format_string("%s | %s | %s (from %s)\n", "node_id", "node_type", "name", "source")
    some = entries.filter(F.col("source") != item).orderBy("node_id").limit(most_chars // 11 + 1).select("node_id", line.alias("line"))
    w = W.orderBy("node_id")  # the budget bounds the rows
    return some.withColumn("sum", F.sum(F.length("line")).over(w)).withColumn("rn", F.row_number().over(w)).filter((F.col("sum") <= most_chars) | (F.col("rn") == 1)).select("node_id", "line")


def token_set(entries: DataFrame) -> DataFrame:
    """(token) by which a catalog's entities may be named: ids, names, and names with spaces and underscores exchanged, in lower case."""
    name = F.lower(F.trim("name"))
    return entries.select(F.explode(F.array(F.lower(F.trim("node_id")), name, F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit("_"), F.lit(" ")))).alias("token")).distinct()
