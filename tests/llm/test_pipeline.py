"""Each stage on its own input, against plain Python."""

import hashlib
import importlib.util
import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

from specgraph.llm import _util, bpe, toxicity

from .test_pairs import brute_groups, brute_lines, shingles

TOP = Path(__file__).parents[2]
sys.path.insert(0, str(TOP))
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = _util.read(spark, SF, "documents")
    items = [shingles(r.text) for r in _util.read(spark, SF, "benchmark").collect()]
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        sets = {i: shingles(t) for i, t in before}
        docs = _util.cut(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        if name != "byte_bpe":
            assert docs.columns == names
        if name == "toxicity":
            texts = dict(before)
            got = {r.doc_id: r.toxic for r in _util.read(spark, SF, "labels").collect() if r.doc_id in texts}
            model = toxicity.train(_util.read(spark, SF, "documents"), _util.read(spark, SF, "labels"), toxicity.F.lit(True))
            scores = dict(zip(texts, toxicity.Scorer(model).documents(list(texts.values()))))
            assert after == {i for i, s in scores.items() if s < 0.5} and sum(i in after for i, t in got.items() if t) <= 0.1 * len(got)
        elif name == "line_dedup":
            gone = brute_lines(before)
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, [])) for i, t in before if i not in gone or len(gone[i]) < sum(bool(x.strip()) for x in t.split("\n"))}
            assert len(want) < len(before)
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            ids = sorted(sets)
            pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
            assert after == {i for i, g in brute_groups(pairs, ids).items() if i == g}
        elif name == "decontamination":
            assert after == {i for i, s in sets.items() if not any(q and len(s & q) >= 0.8 * len(q) - 1e-9 for q in items)}
        else:
            ranks = {t: i for i, t in enumerate(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))) if t}
            lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = {i: hashlib.sha256(",".join(map(str, lib.encode_ordinary(t))).encode()).hexdigest() for i, t in before}
            assert {r.doc_id: r.ids_sha256 for r in rows} == want


def test_copies_leave_one(spark, tmp_path):
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        _util.read(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = _util.read(spark, SF, "documents")
    long = "\n".join(" ".join(f"plain{k}x{i}" for i in range(9)) for k in range(4))
    texts = {900000 + i: long for i in range(5)} | {900010 + i: "quite short" for i in range(3)} | {900020: "\n \n", 900021: long.split("\n")[2] + "\nown line of another document here"}
    more = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[more[c].cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.doc_id >= 900000} == {900000, 900010, 900020, 900021}
    assert not [r.doc_id for r in rows if r.n_tokens == 0]


def test_odd_input(spark):
    """Nulls in every column, empty and repeated rows, ties, a very long text, columns with clashing names, empty tables."""
    import corpus_pipeline

    own = "\n".join(f"line {k} of a text that nothing else in here resembles at all" + "".join(f" z{k}{j}" for j in range(30)) for k in range(3))
    item = _util.read(spark, SF, "benchmark").filter("text is not null").first().text
    rows = [
        (1, own, None, None, None), (2, own, "en", "s", 5), (2, own, "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "\n \n", "en", "s", 3), (None, "no id here", None, None, None),
        (None, None, None, None, None), (6, "short", "en", "s", 5), (7, "short", "en", "s", 5), (8, f"before {item} after", "en", "s", 9), (9, " ".join(f"w{k}" for k in range(200_000)), "en", "s", 9), (10, own + "\nmore", "en", "s", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema + ", norm string, line_no int, rep int, item_id int")
    alive = {"toxicity": {*range(1, 11), None}, "line_dedup": {1, 3, 4, 5, 6, 8, 9, 10, None}, "near_duplicates": {1, 3, 4, 5, 6, 8, 9, 10, None}, "decontamination": {1, 3, 4, 5, 6, 9, 10, None}, "byte_bpe": {1, 3, 4, 5, 6, 9, 10, None}}
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        names = docs.columns
        docs = _util.cut(stage(spark, docs, SF), f"odd-{name}")
        got = [r.doc_id for r in docs.collect()]
        assert set(got) == alive[name] and got.count(None) == 2, name
        assert docs.columns == names or name == "byte_bpe"
    texts = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert texts[3] == texts[4] == 0 and texts[10] < texts[1]


def test_names():
    spec = importlib.util.spec_from_file_location("entry", TOP / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    q = entry.queries()
    assert "pipeline" in q and {n.split("_")[0] for n in q if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(q)
