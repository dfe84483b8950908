import itertools

import numpy as np

from specgraph.llm import hnsw


def brute(vectors):
    ok = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    return [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= 0.95]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    monkeypatch.setattr(hnsw, "TASK_ROWS", 90)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * rng.choice([0.02, 0.2, 1.0])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [float("inf")] + [1.0] * 15), (505, [None] + [1.0] * 15), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e-38] * 16), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows] + [(None, [1.0] * 16, 5, 6)], "vec_id long, embedding array<float>, rep int, size int")
    pairs = brute({i: (i, v) for i, v in rows}.values())
    root = {i: i for i, _ in rows}
    for _ in range(40):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    assert set(got) == {i for i, _ in rows}
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.98 * len(pairs) <= found <= len(pairs) and len(pairs) > 2000
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in got)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_a_graph():
    rng = np.random.default_rng(2)
    x = hnsw.unit(np.repeat(rng.normal(size=(40, 32)), 50, axis=0) + rng.normal(size=(2000, 32)) * 0.1)
    a, b = hnsw.Graph(x).within(x.astype(np.float32), 0.95, 16)
    true = (x @ x.T >= 0.95).sum()
    assert len(a) >= 0.98 * true and len(set(zip(a.tolist(), b.tolist()))) == len(a)


def test_audit_is_not_hidden_by_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(1, 24)) + rng.normal(size=(400, 24)) * 0.02] + [rng.normal(size=(1, 24)) + rng.normal(size=(4, 24)) * 0.1 for _ in range(100)]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate(x).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = hnsw.Graph.within

    def deaf(self, q, least, beam):  # a beam below 64 loses all pairs but those of large groups
        a, b = whole(self, q, least, beam)
        many = np.bincount(a, minlength=len(q)) > 16
        return (a, b) if beam >= 64 else (a[many[a]], b[many[a]])

    # In the tasks' place, in this process: what search() does with all shards at once.
    frame = hnsw.pd.DataFrame({"rep": [r[0] for r in rows], "size": 1, "embedding": [np.array(r[1], dtype=np.float32) for r in rows]})
    shard = hnsw.build((24, 0), frame)
    monkeypatch.setattr(hnsw.Graph, "within", deaf)
    got = hnsw.audited(frame, shard, 0.95)
    at = {b: g for b, g in got.groupby("beam")}
    assert at[16]["found"].sum() >= 0.99 * at[16]["true"].sum()  # by pairs it passes
    assert (at[16]["found"] / at[16]["true"]).mean() < 0.99 and at[16]["narrow_found"].sum() == 0
    assert (at[64]["found"] / at[64]["true"]).mean() >= 0.99 and at[64]["narrow_found"].sum() >= 0.99 * at[64]["narrow"].sum()
    monkeypatch.setattr(hnsw.Graph, "within", whole)
    classes = df.select(hnsw.F.col("vec_id").alias("rep"), "embedding", hnsw.F.lit(24).alias("dim"))
    index = spark.createDataFrame(shard.values.tolist(), "dim int, shard int, ids binary, sizes binary, raw binary, levels binary, links array<binary>")
    assert hnsw.first_beam(classes, index, len(rows), 1, 0.95)[1] >= 0.99
    monkeypatch.setattr(hnsw, "RECALL", 1.01)
    assert hnsw.first_beam(classes, index, len(rows), 1, 0.95)[0] is None
    monkeypatch.setattr(hnsw, "RECALL", 0.99)
    monkeypatch.setattr(hnsw, "MOST_AUDITED", 256)
    monkeypatch.setattr(hnsw, "LEAST_AUDITED", 2000)  # too few pairs: not passed
    assert hnsw.first_beam(classes, index, len(rows), 1, 0.95)[0] is None
    every = hnsw.search(frame, shard, 0.95, None)
    assert every["links"].sum() == 2 * len(brute(rows))
