"""Containment search, n-gram Jaccard join, line dedup, components against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specgraph.llm import components, decontam, line_dedup, ngram_join

random.seed(9)
VOCAB = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(random.choices(VOCAB, k=n))


def edit(t, k):
    w = t.split()
    for _ in range(k):
        w[random.randrange(len(w))] = random.choice(VOCAB)
    return " ".join(w)


def shingles(t):
    w = decontam.words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment(spark, monkeypatch):
    items = [(i, text(random.randrange(5, 60))) for i in range(30)] + [(100, "too short"), (101, None), (102, ""), (103, "a a a a a a a")]
    docs = [(i, " ".join([text(200), edit(random.choice(items[:30])[1], random.randrange(4)), text(50)]).upper()) for i in range(60)]
    docs += [(200, None), (201, ""), (202, "a " * 50), (203, items[0][1]), (203, items[0][1]), (None, items[1][1])]
    want = set()
    for (d, t), (i, u) in itertools.product(docs, items):
        s, q = shingles(t), shingles(u)
        if q and len(s & q) >= 0.8 * len(q) - 1e-9:
            want.add((d, i, len(s & q), len(q)))
    dd = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_SHINGLES, 300):
        monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontam.contained(dd, ii).collect()}
        assert got == want and len(want) > 20
    assert decontam.contained(dd, ii.limit(0)).count() == 0 and decontam.contained(dd.limit(0), ii).count() == 0
    left = {r.doc_id for r in decontam.decontaminate(dd, ii).collect()}
    assert left == {d for d, _ in docs if d is None or d not in {w[0] for w in want}}


def brute_groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_ngram_join(spark, monkeypatch):
    base = [text(120) for _ in range(12)]
    docs = [(i, edit(random.choice(base), random.randrange(6))) for i in range(90)] + [(200 + i, base[0]) for i in range(15)]
    docs += [(300, None), (301, ""), (302, "one two three"), (303, "one two three"), (304, text(3000)), (305, base[1] + " tail"), (305, base[1] + " tail"), (306, base[0].upper() + " !!")]
    sets = {i: shingles(t) for i, t in docs}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    group = brute_groups(pairs, sets)
    links = {i: sum(i in p for p in pairs) for i in sets}
    df = spark.createDataFrame([(*r, 1, 2) for r in docs] + [(None, "null id", 1, 2)], "doc_id long, text string, rep int, size int")
    for block in (ngram_join.BLOCK, 6000):  # packed together, and cut into pairs of blocks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
        assert set(got) == set(sets)
        for i in sets:
            same = [j for j in sets if sets[i] and sets[j] == sets[i]]
            assert (got[i].n_links, got[i].component_id, got[i].kept, got[i].class_id) == (links[i], group[i], group[i] == i, min(same, default=i))
    assert len(pairs) > 200
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if group[i] == i} | {None}


def test_ngram_join_empty_blocks(spark, monkeypatch):
    """Pairs of long texts in components above a block: many blocks have one member or none, on whichever side."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    for seed in range(3):
        random.seed(seed)
        docs = []
        for k in range(8):
            t = text(random.choice((1000, 2000, 4000)))
            docs += [(10 * k + j, edit(t, j * 5)) for j in range(random.choice((2, 2, 3)))]
        sets = {i: shingles(t) for i, t in docs}
        pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
        got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        group = brute_groups(pairs, sets)
        assert got == {i: (sum(i in p for p in pairs), group[i]) for i in sets} and len(pairs) >= 8


def test_prefixes():
    deep = np.full((3, ngram_join.TREES), ngram_join.DEPTH)
    depths, recall = ngram_join.choose_depths(deep, 0.8, 0.9999)
    assert recall == 1 and 1 - np.prod([1 - 0.8**d for d in depths]) >= 0.9999 and len(set(depths)) > 1
    deep[2] = 1  # a pair that only prefixes of one value find
    depths, recall = ngram_join.choose_depths(deep, 0.8, 0.9999)
    assert recall == 1 and min(depths) == 1


def brute_lines(docs):
    seen, gone = [], {}
    for i, t in sorted(d for d in docs if d[0] is not None and d[1] is not None):
        for k, line in enumerate(t.split("\n")):
            s = set(line.lower().replace("\t", " ").split(" ")) - {""}
            if not s:
                continue
            if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                gone.setdefault(i, []).append(k)
            seen.append(s)
    return gone


def test_line_dedup(spark):
    pool = [text(random.choice((1, 2, 4, 5, 9, 10, 30, 60))) for _ in range(40)]
    docs = [(i, "\n".join(edit(random.choice(pool), random.randrange(3)) for _ in range(random.randrange(1, 8)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n\n \n"), (103, pool[0] + "\n\n" + pool[0].upper() + "\t"), (104, text(4000)), (105, "same\nsame\nsame"), (None, "null id\nnull id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, line_no int, norm int")
    want = brute_lines(docs)
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()}
    assert {i: v for i, v in got.items() if v} == want and set(got) == {d[0] for d in docs}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    for i, t in docs:
        assert out[i] == (t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, [])))
    assert line_dedup.dedup_lines(df).columns == df.columns and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_large_group(spark):
    """One group of near copies, too far apart for one representative, and lines that share rare words with it and no more."""
    base = [f"rare{i}" for i in range(40)]
    near = [" ".join(f"own{k}x{j}" if random.random() < 0.07 else w for j, w in enumerate(base)) for k in range(2000)]
    other = [" ".join(base[k % 40 : k % 40 + 3] + random.choices(VOCAB, k=30)) for k in range(300)]
    lines = near + other
    random.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 23 : i * 23 + 23])) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()}
    want = brute_lines(docs)
    assert {i: v for i, v in got.items() if v} == want and sum(map(len, want.values())) > 1500


def rows_joined(spark, before):
    """The most rows that a join made since there were ``before`` executions."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(before, store.executionsCount()):
        run = store.executionsList(k, 1).head().executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_line_dedup_rows(spark):
    """Near copies of one line meet about once a pair that is left to decide, and few are left."""
    rng = random.Random(4)
    base = [f"rare{i}" for i in range(40)]
    lines = [" ".join(rng.choice(VOCAB) if rng.random() < 0.07 else w for w in base) for _ in range(1200)]
    lines += [" ".join(rng.choices(VOCAB, k=40)) for _ in range(600)]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 18 : i * 18 + 18])) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(df).collect()}
    made = rows_joined(spark, before)
    assert {i: v for i, v in got.items() if v} == brute_lines(docs)
    assert 0 < made < 150_000


def test_line_dedup_wide_ids(spark):
    """Ids of more than 32 bits, on either side of 0, stand in the same order as small ones."""
    line = text(20)
    for ids in ([-(2**31), -1, 2**31 - 1], [-(2**40), -1, 2**31], [-(2**63), 0, 2**63 - 1], [-(2**31) - 1, -(2**31), 5]):
        docs = [(i, f"{text(9)}\n{line}\n \t\n{line.upper()}") for i in ids]
        got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert {i: v for i, v in got.items() if v} == brute_lines(docs) == {ids[0]: [3], ids[1]: [1, 3], ids[2]: [1, 3]}


def plans(spark, before):
    """Descriptions of the executions since there were ``before``."""
    store = spark._jsparkSession.sharedState().statusStore()
    return [store.executionsList(k, 1).head().physicalPlanDescription() for k in range(before, store.executionsCount())]


def test_line_dedup_work(spark):
    """Lines are brought to their common form once, the first pass needs no join, and the join by tokens cuts the smaller side's prefix behind the shuffle."""
    docs = spark.createDataFrame([(i, "\n".join(text(12) for _ in range(5))) for i in range(40)], "doc_id long, text string")
    plan = line_dedup.distinct_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter" in row and "lower" in row for row in plan.splitlines())
    sets = line_dedup.line_sets(line_dedup.distinct_lines(docs), 0.8)
    assert "Join" not in line_dedup.first_candidates(sets, 0.8)._jdf.queryExecution().executedPlan().toString()
    matched = line_dedup._util.cut(sets.select("doc_id", "line_no").limit(3), "matched")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_dedup.candidates(sets, matched, 0.8).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = [p for p in plans(spark, before) if "SortMergeJoin" in p and "token" in p]
    assert len(joined) == 1
    assert "spark_partition_id" in joined[0].lower()


def test_components(spark):
    ids = list(range(60))
    pairs = [(random.choice(ids), random.choice(ids)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (7, None)]
    want = brute_groups([p for p in pairs if None not in p], {x for p in pairs for x in p if x is not None})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for a, b in pairs if None not in (a, b) and a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}
    assert components.components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)
    assert {r.component for r in components.components(chain).collect()} == {0}
