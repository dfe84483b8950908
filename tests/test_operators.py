"""Cases that the tables don't hold: order, ties, odd inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from specgraph.functions import providers
from specgraph.operators import analytics, cleaning, flow, qa, roles, testcases, textual, versions
from specgraph.sources import blocks, storage


def test_dedup_and_conflicts(spark):
    rows = [("A-b", "Action", None, "s", 1), ("a_b", "Actor", "d", "s", 2), ("a b", "Feature", None, "s", 3), ("X", "Odd", None, "s", 4), ("x", "Odder", None, "s", 5)]
    n = spark.createDataFrame(rows, "node_id string, node_type string, description string, source string, ord long")
    got = {(r.node_id, r.node_type, r.occ) for r in cleaning.dedup_nodes(n).collect()}
    assert got == {("a_b", "Actor", 3), ("x", "Odd", 2)}
    assert {(r.ord, r.kept_type, r.ignored_type) for r in cleaning.type_conflicts(n).collect()} == {(2, "Actor", "Action"), (3, "Actor", "Feature"), (5, "Odd", "Odder")}


def test_edge_rules(spark):
    n = spark.createDataFrame([("a", "Actor"), ("s", "Screen"), ("d", "DataObject")], "node_id string, node_type string")
    e = spark.createDataFrame([("a", "s", "shows"), ("s", "a", "creates"), ("d", "s", "AUTHENTICATES"), ("a", "zz", "USES"), ("a", "d", "USES"), ("d", "a", "USES"), ("s", "s", "USES"), ("s", "d", "SUPPORTS"), ("d", "s", "SUPPORTS")], "src_id string, dst_id string, rel_type string")
    got = {(r.src_id, r.dst_id, r.rel_type): list(r.reasons) for r in cleaning.check_edges(e, n).collect()}
    assert got[("a", "s", "SHOWS")] == ["actor as source"] and got[("s", "a", "CREATES")] == ["actor as target"]
    assert got[("d", "s", "AUTHENTICATES")] == ["source cannot authenticate"] and got[("a", "zz", "USES")] == ["target not found"]
    assert got[("a", "d", "USES")] == got[("d", "a", "USES")] == got[("s", "s", "USES")] == ["contradicts its reverse"]
    assert got[("s", "d", "SUPPORTS")] == got[("d", "s", "SUPPORTS")] == []


def test_roles(spark):
    n = spark.createDataFrame([("TC::1", "Thing", "x"), ("p", "Odd", "Login Page"), ("q", "Odd", "zzz"), ("r", "Attribute", "y"), ("s", "Action", "go")], "node_id string, node_type string, name string")
    got = {r.node_id: (r.role, r.confidence) for r in roles.classify_nodes(n).collect()}
    assert got == {"TC::1": ("artifact", 1.0), "p": ("ui_element", 0.8), "q": ("other", 0.3), "r": ("metadata", 0.95), "s": ("workflow_step", 0.95)}


def test_components_and_reach(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefz"], "node_id string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d"), ("a", "gone")], "src_id string, dst_id string")
    assert {r.node_id: r.component for r in analytics.components(n, e).collect()} == dict(a="a", b="a", c="a", d="d", e="d", f="d", z="z")
    assert {(r.src_id, r.dst_id, r.depth) for r in analytics.reach(e.filter("src_id in ('d', 'e', 'f')"), 3).collect()} >= {("d", "d", 3), ("d", "f", 2)}
    with pytest.raises(ValueError):
        analytics.page(n, 5000)


def test_flow_of_a_loop():
    edges = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("s", "d"), ("c", "c")]
    f = flow.Flow(pd.DataFrame([(a, b, k, "edge") for k, (a, b) in enumerate(edges)], columns=["src_id", "dst_id", "pos", "kind"]))
    assert f.roots == ["s"] and f.dominators()["d"] == {"s", "d"} and f.dominators()["c"] == {"s", "a", "b", "c"}
    assert f.loops() == {"a": {"a", "b", "c"}, "c": {"c"}}
    assert {k for _, _, k in f.classes()} == {"tree", "back", "forward"}
    assert [n for _, n, _ in f.walk()] == ["s", "a", "d", "b", "c"]


def test_communities_of_two_cliques():
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    got = flow.louvain(sorted({n for p in pairs for n in p}), pairs)
    assert len(set(got.values())) == 2 and len({got[f"x{i}"] for i in range(5)}) == 1


def test_mentions():
    assert [m[:2] for m in textual.mentions("see NFR-001, fr002 and BR_PAY_X_1; xFR-003 R-9")] == [("NFR", "NFR-001"), ("FR", "fr002"), ("BR", "BR_PAY_X_1")]


def test_splitter():
    text = "\n\n".join(" ".join(f"word{i}" for i in range(k, k + 60)) for k in range(0, 900, 60)) + "x" * 900
    pieces = textual.split_text(text, 400, 50)
    assert all(len(p) <= 400 for p in pieces)
    strip = lambda s: "".join(s.split())
    at = 0
    for p in map(strip, pieces):
        at = max(strip(text).find(p[-20:], max(0, at - 400)), at)
    assert all(strip(p) in strip(text) for p in pieces) and pieces[-1].endswith("x") and at > 0


def test_blocks_and_markdown(spark):
    text = "# Title\nSome text\n\n- one\n- two\n1. first\n2. second\nSHORT HEAD\na | b\nc | d\nlone | row\n\nx | y\nend"
    b = blocks.text_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [(r.kind, r.content) for r in b.orderBy("block_no").collect()]
    assert got == [("heading", "Title"), ("paragraph", "Some text"), ("list_item", "one"), ("list_item", "two"), ("list_item", "first"), ("list_item", "second"), ("heading", "Short Head"), ("table", "a | b\nc | d\nlone | row"), ("paragraph", "x | y"), ("paragraph", "end")]
    md = blocks.to_markdown(b).first().markdown
    assert md == "# Title\n\nSome text\n\n- one\n- two\n1. first\n2. second\n## Short Head\n\n| a | b |\n| --- | --- |\n| c | d |\n| lone | row |\n\nx | y\n\nend\n"


def test_versions(spark):
    a = spark.createDataFrame([("x", "A", None, ["p", "q"]), ("y", "A", "d", None)], "node_id string, node_type string, description string, aliases array<string>")
    b = spark.createDataFrame([("x", "A", None, ["q", "p"]), ("z", "A", "d", None)], a.schema)
    assert {(r.node_id, r.status) for r in versions.diff_nodes(a, b).collect()} == {("y", "removed"), ("z", "added")}


def test_storage(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "node_id string, doc_id string, ord int")
    folder = f"file://{tmp_path}/nodes"
    storage.save(old, folder)
    storage.save(storage.upsert(storage.latest(spark, folder), spark.createDataFrame([("a", None, 3), ("a", None, 4)], old.schema), ["node_id"], ("doc_id",)), folder)
    assert {tuple(r) for r in storage.latest(spark, folder).collect()} == {("a", "x", 4), ("b", "y", 2)}
    p = spark.createDataFrame([("n", "l", 1, "old")], "name string, label string, version int, template string")
    assert storage.save_prompt(p, "n", "l", "new {q}", ("q",)).agg(F.max("version")).first()[0] == 2
    with pytest.raises(ValueError):
        storage.save_prompt(p, "n", "l", "new", ("q",))


def test_classes_of_test_cases(spark):
    rows = [("1", "Login", None, None, "see not found page", ["go"]), ("2", "ok", "Boundary", None, "", ["x"]), ("3", "plain", None, None, "fine", ["try again"]), ("4", "Edge of it", None, None, "", [])]
    t = spark.createDataFrame(rows, "tc_id string, title string, scenario string, precondition string, expected_result string, steps array<string>")
    assert {r.tc_id: r["class"] for r in testcases.classify(t).collect()} == {"1": "negative", "2": "edge", "3": "failure_retry", "4": "edge"}


def test_providers_and_questions(spark):
    assert providers.first_json('noise {"a": [1]} tail') == '{"a": [1]}' and providers.first_json("none") is None
    assert providers.first_sentences(["One. Two! Three?"]) == ["One. Two!"]
    v = providers.hashed_embedding(["login page", "payment gateway"])
    n = spark.createDataFrame([("login", v[0]), ("pay", v[1])], "node_id string, vector array<double>")
    e = spark.createDataFrame([("login", "LEADS_TO", "pay")], "src_id string, rel_type string, dst_id string")
    c = spark.createDataFrame([("c1", v[1], "about payment")], "id string, vector array<double>, text string")
    assert qa.ask(n, e, c, "login page")["context"] == "login LEADS_TO pay"
    assert qa.ask(n, e, c, "unrelated words")["tier"] == "text"
    out = providers.apply(spark.createDataFrame([("A. B. C.",)], "t string"), providers.first_sentences, "t", "s", "string")
    assert out.first().s == "A. B."
