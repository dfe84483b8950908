"""Walks, features, predicates and pages against plain Python and on cases that the tables don't hold."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from specgraph.functions import groups
from specgraph.functions import ontology as O
from specgraph.operators import api, extraction, features, reports
from specgraph.plans import catalog
from specgraph.sources import storage


def test_walk_is_depth_first():
    after = {"a": ["c", "b"], "c": ["d", "a"], "x": ["y"], "y": ["x", "out"]}
    assert features.ordered_walk("a", ["a", "b", "c", "d", "x", "y"], after) == ["a", "c", "d", "b", "x", "y"]


def test_steps_are_expanded():
    types = {"s": "Action", "scr": "Screen", "inp": "UIElement", "btn": "UIElement", "nxt": "State", "feat": "Feature", "t": "Action"}
    names = {"s": "Pay", "scr": "Cart", "inp": "Amount", "btn": "Submit button", "nxt": "Paid", "feat": "Shop", "t": "Paid"}
    touching = [("s", "btn", "USES"), ("s", "inp", "USES"), ("s", "nxt", "LEADS_TO"), ("scr", "s", "SHOWS"), ("feat", "s", "CONTAINS"), ("s", "feat", "NEXT")]
    assert features.expanded(["s", "t"], touching, types, names) == ["scr", "inp", "btn", "s", "nxt"]  # t has the name of the step before
    assert features.expanded(["feat", "s"], [], types, names) == ["s"]


def test_cycle_begins_where_most_leads_out():
    rows = [("f", "node", n, "Action", n.upper(), "workflow_step", None) for n in "abc"] + [("f", "move", a, b, "LEADS_TO", None, 0) for a, b in ("ab", "bc", "ca", "ba")]
    made = features._one(pd.DataFrame(rows, columns=["feature", "kind", "a", "b", "rel", "role", "pos"]))
    assert made["entry_id"] == "b" and made["walk"] == ["b", "a", "c"] and made["decisions"] == ["b"] and made["ends"] == []


def brute_walk(nodes, edges, item):
    """The greedy walk of one item; nodes: id to (type, source), edges: (src, dst, rel)."""
    own = {n for n, (_, s) in nodes.items() if s == item}
    ways = {}
    has_in = set()
    for a, b, r in edges:
        if a == b or a not in nodes or b not in nodes:
            continue
        if (a in own and b in own) or (r in O.FLOW_RELATIONS and (a in own) != (b in own)):
            ways.setdefault(a, []).append((b, r))
            has_in.add(b)
    every = own | set(ways)
    out = [n for n in sorted(every) if n in ways]
    if not out:
        return [min(every)]
    rank = lambda n: (0, 0) if nodes[n][0] in features.ACTOR_TYPES else (1, 0) if n not in has_in else (2, -len(ways[n]))
    at = min(out, key=lambda n: (*rank(n), n))
    path = [at]

    def order(way):
        b, r = way
        kind = nodes[b][0]
        bucket = -1 if r in O.FLOW_RELATIONS else next((k for k, t in enumerate(features.HOP_TYPES) if kind in t), len(features.HOP_TYPES))
        return bucket, b, r

    for _ in range(features.MOST_HOPS):
        options = [w for w in ways.get(path[-1], []) if w[0] not in path]
        if not options:
            break
        path.append(min(options, key=order)[0])
    return path


def test_item_walks(spark):
    random.seed(5)
    kinds = ["Actor", "Action", "State", "Screen", "DataObject", "Feature", "Odd"]
    nodes = {f"n{i}": (random.choice(kinds), f"R{i % 6}") for i in range(40)} | {"lone": ("Action", "R9")}
    edges = sorted({(f"n{random.randrange(42)}", f"n{random.randrange(42)}", random.choice(("LEADS_TO", "USES", "PART_OF", "PERFORMS"))) for _ in range(160)})
    n = spark.createDataFrame([(i, t, s) for i, (t, s) in nodes.items()], "node_id string, node_type string, source string")
    got = {}
    for r in sorted(features.item_walks(n, spark.createDataFrame(edges, "src_id string, dst_id string, rel_type string")).collect(), key=lambda r: (r.item_id, r.hop)):
        got.setdefault(r.item_id, []).append(r.node_id)
    assert got == {item: brute_walk(nodes, edges, item) for item in {s for _, s in nodes.values()}}


def test_page_limits_and_choices(spark):
    n = spark.createDataFrame([("a", "Actor", "Allocation", None), ("b", "Action", "x", "Allocation"), ("c", "Action", "x", "y")], "node_id string, node_type string, source string, doc_id string")
    e = spark.createDataFrame([("a", "b", "USES"), ("a", "b", "USES"), ("b", "c", "USES"), ("a", "b", "OWNS")], "src_id string, dst_id string, rel_type string")
    p = api.page(n, e, doc=" Allocation ", relation="USES", limit=2)
    assert {r.edge_id for r in p.edges.collect()} == {"edge:a-USES->b:0", "edge:a-USES->b:1"}
    assert tuple(p.about.first()) == (2, 2, 3, 4, True)
    assert api.page(n, e, doc="All Documents", kind="All", relation=" ").about.first().edge_count == 4
    with pytest.raises(ValueError):
        api.page(n, e, limit=0)
    assert {r.node_id for r in storage.document_graph(n, e, "Allocation")[0].collect()} == {"a", "b"}  # begins like a word for all
    assert storage.document_graph(n, e, "All")[0].count() == 3


def test_texts_without_content(spark):
    df = spark.createDataFrame([(None,), ("",), ("page 3 of 9",), ("Author: x, Version 2",), ("then " * 10,)], "t string")
    rows = df.select(extraction.metadata_reason(F.col("t")), extraction.is_procedural(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(None, False), (None, False), ("page_header_footer", False), ("document_control_table", False), (None, True)]


def test_coverage_of_names(spark):
    nodes = spark.createDataFrame([("feature_login", "Login Portal"), ("x1", "Quarterly figures"), ("x2", "Zebra"), ("ab", "it")], "node_id string, name string")
    corpus = spark.createDataFrame([("Open the login page",), ("see figures of the \"year\"",), (None,)], "text string")
    got = {r.node_id: r.covered for r in reports.covered_nodes(nodes, corpus).collect()}
    assert got == {"feature_login": True, "x1": True, "x2": False, "ab": False}
    edges = spark.createDataFrame([("feature_login", "x1"), ("x1", "x2")], "src_id string, dst_id string")
    assert tuple(reports.coverage(nodes, corpus, edges).first()) == (4, 2, 50.0, 2, 1, 50.0)
    assert tuple(reports.coverage(nodes.limit(0), corpus, edges).first()) == (0, 0, 100.0, 0, 0, 100.0)


def test_flags(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    e = spark.createDataFrame([("a", "b")], "src_id string, dst_id string")
    got = {r.flag: (r.status, r.detail) for r in reports.structure(n, e).collect()}
    assert got["isolated nodes"] == ("WARN", "1") and got["fragmentation"][0] == "WARN" and got["hubs"] == ("WARN", "b touches 50.0%")


def test_prompts_without_placeholder(spark):
    prompts = spark.createDataFrame([("p", "l", 1, "{text}")], "name string, label string, version int, template string")
    with pytest.raises(ValueError):
        storage.save_prompt(prompts, "p", "l", "none", ("text",))
    assert storage.delete_prompt(prompts, "p").count() == 0


def brute_covered(name, node, texts):
    """The rule of covered_nodes on plain strings."""
    plain = lambda c: re.sub(r"\s+", " ", re.sub(r"[\"'\\\\]", "", c or "").lower()).strip()
    texts = [plain(t) for t in texts]
    name, node = plain(name), plain(node)
    begin = r"^(feature_|system_|app_)"
    short = re.sub(r"(\s+message|\s+portal|\s+app)$", "", re.sub(begin, "", name))
    code = re.sub("(_message|_portal|_app)$", "", re.sub(begin, "", node))
    noise = {*reports.STOP_WORDS, *reports.NAME_NOISE}
    tokens = {w for x in (short, code) for w in re.split(r"[_\-\s]+", x) if len(w) >= 3 and w not in noise}
    words = {w for t in texts for w in re.findall("[a-z0-9]+", t) if len(w) >= 3 and w not in noise | {"app"}}
    if any(len(x) >= 3 and x in t for x in (name, node, short, code) for t in texts) or (tokens and len(tokens & words) >= 0.4 * len(tokens)):
        return True
    return any(w[:4] in t for w in tokens if len(w) >= 4 and w not in reports.CORE_NOISE for t in texts)


def test_coverage_of_random_names(spark):
    random.seed(8)
    words = ["login", "portal", "the", "zeta", "figure", "x-ray", "app_", "feature_", "42", "it", "qu\"ote", "überweisung", "page"]
    some = lambda least, most: random.choice((" ", "_")).join(random.choices(words, k=random.randint(least, most)))
    nodes = [(f"{random.choice(('feature_', 'n', ''))}{some(1, 2)}{i}", random.choice((None, some(1, 3), some(1, 3)))) for i in range(120)]
    texts = [some(0, 4)[random.randint(0, 3):] for _ in range(4)] + [None, ""]
    got = reports.covered_nodes(spark.createDataFrame([*nodes, nodes[0]], "node_id string, name string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = [(n, brute_covered(name, n, texts)) for n, name in [*nodes, nodes[0]]]
    assert sorted((r.node_id, r.covered) for r in got) == sorted(want) and {c for _, c in want} == {True, False}


def test_coverage_has_no_largest_corpus(spark):
    corpus = spark.range(0, 170_000, numPartitions=4).select(F.repeat(F.lit("nothing to see "), 7).alias("text"))  # 17.85 M characters
    nodes = spark.createDataFrame([("a", "hing to se"), ("b", "zebra")], "node_id string, name string")
    assert {r.node_id: r.covered for r in reports.covered_nodes(nodes, corpus).collect()} == {"a": True, "b": False}


def test_many_small_groups(spark):
    rows = spark.range(0, 90_000, numPartitions=5).select((F.col("id") % 30_000).alias("g"), F.when(F.col("id") > 4, F.col("id")).alias("v"))
    got = groups.per_group(rows, "g", lambda g, found: [(g, [v for _, v in found if v is not None])] * (g % 3), "g long, v array<long>")
    assert {r.g: sorted(r.v) for r in got.collect()} == {g: [v for v in (g, g + 30_000, g + 60_000) if v > 4] for g in range(30_000) if g % 3}
    assert got.count() == 30_000


def test_numbers_follow_size_and_id(spark):
    random.seed(2)
    found = spark.createDataFrame([(f"f{i}", "n", random.randrange(5)) for i in range(500)], "feature string, name string, size int").repartition(7)
    rows = features.numbered(found).collect()
    assert [r.feature for r in sorted(rows, key=lambda r: r.number)] == [r.feature for r in sorted(rows, key=lambda r: (-r.size, r.feature))]
    assert sorted(r.number for r in rows) == list(range(500))


@pytest.mark.parametrize("name", ["agg16_scenario_score", "gr10_features", "jn21_failure_trace", "prj20_feature_subgraph", "prj32_contract"])
def test_groups_are_not_data_frames(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") <= (name not in ("jn21_failure_trace", "prj20_feature_subgraph"))  # what several steps read is made once
