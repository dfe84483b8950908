"""Test cases: classification, duplicates, variants, grounding, coverage.

Test cases have tc_id, title, scenario, precondition, expected_result, steps (array) and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import first_match

# Cues of the scenario classes, tried in this order.
CUES = (
    ("negative", ("invalid", "error", "fail", "failed", "failure", "incorrect", "denied", "reject", "rejected", "unauthorized", "expired", "missing", "forbidden", "exception", "wrong", "bad", "unavailable", "cannot", "blocked", "not found", "incorrect password", "wrong otp", "invalid payment")),
    ("edge", ("limit", "maximum", "max", "minimum", "min", "boundary", "threshold", "lock", "locked", "timeout", "empty", "overflow", "exceed", "zero", "exactly", "upper", "lower", "extreme", "bulk", "large", "capacity")),
    ("failure_retry", ("retry", "recover", "recovery", "loop", "reattempt", "resubmit", "fallback", "re-attempt", "try again", "reconnect", "resume")),
    ("alternate", ("alternate", "alternative", "branch", "option", "bypassed", "skip", "another", "different", "secondary", "additional path", "other way")),
)
# Names of the classes in a scenario field.
NAMES = (
    ("positive", ("positive", "happy", "valid", "success")), ("negative", ("negative", "invalid", "error", "failure")), ("edge", ("edge", "boundary", "limit", "corner")),
    ("alternate", ("alternate", "alternative", "branch")), ("failure_retry", ("failure_retry", "retry", "recovery")),
)
# Cues of a negative outcome in requirement texts.
NEGATIVE_CUES = ("invalid", "error", "fail", "failure", "incorrect", "denied", "deny", "reject", "missing", "unauthorized", "expired", "locked", "timeout", "unable", "cannot", "can not", "does not", "not enrolled", "not moved", "exceed", "wrong", "unsuccessful")
# Words that carry no meaning for coverage.
STOP_WORDS = ("the", "and", "for", "are", "not", "has", "with", "user", "that", "this", "from", "but", "can", "all", "was", "they", "when", "have", "will", "been", "each", "than", "then", "message", "feature", "portal", "system", "app")
# Words of the enrichment's scenario types.
ENRICH = (("Negative", "negative", ("invalid", "fail", "error", "denied")), ("Edge Cases", "edge", ("limit", "max", "min", "boundary", "lock", "timeout")), ("Failure / Retry", None, ("retry", "recover", "reattempt", "loop")), ("Alternate Paths", None, ("alternate", "option", "branch")))


def _text(*cols) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def full_text(tcs: DataFrame) -> DataFrame:
    """Test cases with id and title filled in from each other, and their whole text in lower case."""
    t = tcs.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "tc_id"))
    return t.withColumn("full_text", _text("title", "precondition", "expected_result", "scenario", F.array_join(F.coalesce("steps", F.array().cast("array<string>")), " ")))


def classify(tcs: DataFrame) -> DataFrame:
    """Test cases with ``class``: by the scenario field, the title, else by cue words and pairs of words, else positive."""
    field, title = F.lower(F.trim(F.coalesce("scenario", F.lit("")))), F.lower(F.coalesce("title", F.lit("")))
    words = F.regexp_extract_all(_text("title", "precondition", "expected_result", F.array_join("steps", " ")), F.lit(r"(\w+)"), F.lit(1))
    signals = F.array_union("_w", F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    cases = [(field.isin(*names), F.lit(c)) for c, names in NAMES] + [(F.contains(title, F.lit(c)), F.lit(c)) for c in ("positive", "negative", "edge")]
    cases += [(F.arrays_overlap("_s", F.array(*map(F.lit, cues))), F.lit(c)) for c, cues in CUES]
    return tcs.withColumn("_w", words).withColumn("_s", signals).withColumn("class", first_match(cases, F.lit("positive"))).drop("_w", "_s")


def enrich(tcs: DataFrame) -> DataFrame:
    """Test cases with defaults and the scenario type that parts of words in title, precondition and result suggest."""
    kind, blob = F.lower(F.coalesce("scenario", F.lit("positive"))), _text("title", "precondition", "expected_result")
    cases = [((F.contains(kind, F.lit(word)) if word else F.lit(False)) | blob.rlike("|".join(parts)), F.lit(name)) for name, word, parts in ENRICH]
    return tcs.withColumn("scenario_type", first_match(cases, F.lit("Positive"))).withColumn("precondition", F.coalesce("precondition", F.lit("Valid system state and user session established."))).withColumn("objective", F.format_string("Validate %s path against knowledge graph requirements.", F.lower("title")))


def signature() -> Column:
    alnum = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    return F.concat_ws("::", F.lit("positive"), alnum(F.col("title")), alnum(F.col("precondition")), F.array_join(F.transform("steps", alnum), "->"))


def duplicates(tcs: DataFrame) -> DataFrame:
    """(tc_id, duplicate_of): null for the first of each signature."""
    w = W.partitionBy("_sig").orderBy("ord")
    t = tcs.withColumn("_sig", signature()).withColumn("_first", F.first("tc_id").over(w)).withColumn("_n", F.row_number().over(w))
    return t.select("tc_id", F.when(F.col("_n") > 1, F.col("_first")).alias("duplicate_of"))


def duplication(tcs: DataFrame) -> DataFrame:
    d = duplicates(tcs)
    return d.agg(F.count("*").alias("total"), F.count("duplicate_of").alias("duplicates"), F.round(F.count("duplicate_of") * 100 / F.greatest(F.count("*"), F.lit(1)), 1).alias("ratio"))


def variants(tcs: DataFrame) -> DataFrame:
    """(tc_id, tc_type, title, steps): five variants of every case (feature, steps); cases without steps have no prerequisite to miss. Equal title and steps once."""
    f, s = F.col("feature"), F.col("steps")
    first_at = lambda test: F.array_position(F.transform(s, test), True)
    nav = first_at(lambda x: x.startswith("Navigate to "))
    act = first_at(lambda x: x.startswith("Click ") | x.startswith("Perform "))
    slow = F.transform(s, lambda x, i: F.when(i + 1 == nav, F.regexp_replace(x, r"Navigate to (.+?)\.", "Navigate to $1 under latency threshold.")).otherwise(x))
    other = F.transform(s, lambda x, i: F.when(i + 1 == act, F.when(x.startswith("Click "), F.replace(x, F.lit("Click "), F.lit("Tap / Select "))).otherwise(F.replace(x, F.lit("Perform "), F.lit("Execute alternate ")))).otherwise(x))
    fault = F.concat(F.lit("Trigger runtime exception during "), f, F.lit("."))
    make = lambda suffix, kind, title, steps: F.struct(F.concat("tc_id", F.lit(suffix)).alias("tc_id"), kind.alias("tc_type"), title.alias("title"), steps.alias("steps"))
    negative, edge, own = F.lit("Negative"), F.lit("Edge"), F.coalesce("tc_type", F.lit("Positive"))
    every = F.array(
        make("-NEG", negative, F.concat(F.lit("Negative - "), f, F.lit(" with invalid inputs")), F.transform(s, lambda x: F.when(x.startswith("Enter "), F.regexp_replace(x, r"Enter (.+?)\.", "Enter invalid $1.")).otherwise(x))),
        F.when(F.size(s) > 0, make("-DEP", negative, F.concat(F.lit("Negative - Missing prerequisite step for "), f), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))))),
        make("-EDGE", edge, F.concat(F.lit("Edge - "), f, F.lit(" navigation boundary & latency")), slow),
        make("-ALT", own, F.concat(F.lit("Positive - Alternative interaction path for "), f), other),
        make("-EXC", negative, F.concat(F.lit("Negative - Exception recovery during "), f), F.concat(F.slice(s, 1, 1), F.array(fault), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))))),
    )
    v = tcs.select(F.explode(F.array_compact(every)).alias("v")).select("v.*")
    n = F.row_number().over(W.partitionBy("title", F.array_join("steps", "\u0001")).orderBy("tc_id"))
    return v.withColumn("_n", n).filter("_n = 1").drop("_n")


def phrase(relation: Column, name: Column, kind: Column) -> Column:
    """A step in words for a walk along ``relation`` to a node of that name and type."""
    page, field, deed = kind.isin("Screen", "Page"), kind.isin("DataObject", "Attribute", "UIElement"), kind == "Action"
    result, rule = kind.isin("Output", "State", "Message", "Event"), kind.isin("Condition", "Constraint", "BusinessRule", "Validation")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("."))
    verb = F.concat(F.upper(F.substring(relation, 1, 1)), F.lower(F.translate(F.substr(relation, F.lit(2)), "_", " ")))
    return first_match([
        (page, say("Navigate to ", name)),
        (relation.isin("USES", "CREATES", "UPDATES", "ASSOCIATED_WITH", "PROCESSES") & field, say("Enter ", name)),
        (deed, F.when(F.lower(name).rlike("button|click"), say("Click ", name)).otherwise(say("Perform ", name))),
        (relation.isin("GENERATES", "PRODUCES", "CREATES") & result, say("Verify ", name, " is generated")),
        ((relation == "SHOWS") & result, say("Verify ", name, " is displayed")),
        (result, say("Verify system reaches ", name)),
        (rule, say("Confirm ", name)),
    ], say(verb, " ", name))


def case_ids(tcs: DataFrame) -> DataFrame:
    """Test cases (req_id, title, ord) with tc_id: requirement, number within it, four hex digits of the title's SHA-256."""
    n = F.row_number().over(W.partitionBy("req_id").orderBy("ord"))
    return tcs.withColumn("tc_id", F.concat_ws("-", F.lit("TC"), "req_id", F.lpad(n.cast("string"), 3, "0"), F.substring(F.sha2("title", 256), 1, 4)))


def negative_items(items: DataFrame) -> DataFrame:
    """(item_id, is_negative, cue): items whose text holds a cue of a negative outcome."""
    cue = F.regexp_extract("content", r"(?i)\b(" + "|".join(NEGATIVE_CUES) + r")\b", 1)
    return items.select("item_id", (cue != "").alias("is_negative"), F.nullif(cue, F.lit("")).alias("cue"))


def priorities(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item_id, priority): High for business rules, quality requirements and linked items, else Medium."""
    linked = links.select(F.col("source_id").alias("item_id")).unionByName(links.select(F.col("target_id").alias("item_id"))).distinct().withColumn("_l", F.lit(True))
    return items.join(linked, "item_id", "left").select("item_id", F.when(F.col("family").isin("BR", "NFR") | F.col("_l").isNotNull(), "High").otherwise("Medium").alias("priority"))


def content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def grounding(tcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tc_id, step_no, grounded): whether a step has no content words, shares one with the nodes' names, or contains a name or word of four letters or more.

    Steps that share no word meet the distinct terms text by text; the terms are to be those of one document's graph.
    """
    words = nodes.select(F.explode(content_words(F.col("name"))).alias("w")).distinct()
    terms = words.unionByName(nodes.select(F.lower(F.trim("name")).alias("w"))).filter(F.length("w") >= 4).distinct()
    steps = tcs.select("tc_id", F.posexplode("steps").alias("step_no", "step")).select("tc_id", "step_no", F.lower("step").alias("step"), content_words(F.col("step")).alias("ws"))
    hit = steps.select("tc_id", "step_no", F.explode("ws").alias("w")).join(words, "w", "left_semi").select("tc_id", "step_no").distinct().withColumn("hit", F.lit(True))
    marked = steps.join(hit, ["tc_id", "step_no"], "left")
    told = marked.filter(F.col("hit").isNull() & (F.size("ws") > 0)).select("step").distinct().join(terms, F.contains(F.col("step"), F.col("w")), "left_semi").withColumn("told", F.lit(True))
    return marked.join(told, "step", "left").select("tc_id", "step_no", ((F.size("ws") == 0) | F.col("hit").isNotNull() | F.col("told").isNotNull()).alias("grounded"))


def validates_edges(tcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tc_id, node_id) from the nodes that test cases name (graph_nodes), by id first, else by name (the smallest id)."""
    t = tcs.select("tc_id", F.explode("graph_nodes").alias("g")).select("tc_id", F.lower(F.trim("g")).alias("token"))
    by_name = nodes.groupBy(F.lower(F.trim("name")).alias("token")).agg(F.min("node_id").alias("n"))
    by_id = nodes.groupBy(F.lower(F.trim("node_id")).alias("token")).agg(F.min("node_id").alias("i"))
    return t.join(by_id, "token", "left").join(by_name, "token", "left").select("tc_id", F.coalesce("i", "n").alias("node_id")).filter("node_id is not null").distinct()


def render(tcs: DataFrame) -> DataFrame:
    """(tc_id, text): a test case as numbered lines."""
    steps = F.array_join(F.transform("steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return tcs.select("tc_id", F.concat_ws("\n", F.concat(F.lit("Test Case: "), "tc_id"), F.concat(F.lit("Title: "), "title"), F.lit("Steps:"), steps).alias("text"))


def transitions(tcs: DataFrame) -> DataFrame:
    """(tc_id, pos, step, next): consecutive steps."""
    return tcs.select("tc_id", F.posexplode("steps").alias("pos", "step")).withColumn("next", F.lead("step").over(W.partitionBy("tc_id").orderBy("pos"))).filter("next is not null")
