import random

import numpy as np
from pyspark.sql import functions as F

from specgraph.llm import _util, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "x" * 200_000), (4, "a\nb"), (4, "a\nb"), (None, "null id")]


def held(spark, module, label, k):
    labels = _util.read(spark, SF, "labels")
    rows = module.query(spark, SF).join(labels, "doc_id").filter("held_out").select("score", label).collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    assert len(rows) > 50 and ((s >= 0) & (s <= 1)).all()
    return s, y


def test_quality_on_held_out_rows(spark):
    s, y = held(spark, quality, "quality", 3)
    assert ((s >= 0.5) == y).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    s, y = held(spark, toxicity, "toxic", 5)
    assert ((s >= 0.5) == y).mean() > 0.9 and s[y == 1].mean() > s[y == 0].mean() + 0.3


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (9, 1), (9, 1), (2, None)], "doc_id long, quality int")
    for model, module in ((quality.train(docs, labels, F.lit(True)), quality), (toxicity.train(docs, labels.withColumnRenamed("quality", "toxic"), F.lit(True)), toxicity), (quality.train(docs, labels.limit(0), F.lit(True)), quality)):
        rows = module.score(docs, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(docs.limit(0), model).count() == 0


def test_sentences_are_found(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(200)]
    sentence = lambda: " ".join(random.choices(words, k=8)) + "."
    texts, label = [], []
    for i in range(300):
        parts = [sentence() for _ in range(6)]
        if i % 4 == 0:
            parts[i % 6] = f"you {random.choice(('scum', 'scummy', 'scumbag'))} {sentence()}"
        texts.append(" ".join(parts) if i % 2 else "\n".join(parts))
        label.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(label))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.sentence_no) for r in toxicity.offending(docs, model).collect()}
    assert got == {(i, i % 6) for i in range(0, 300, 4)}
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i in range(300) if i % 4}


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x @ [2, -1, 0, 0, 0.5] > 0.3).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    assert abs((model.score(x) >= 0.5).mean() - y.mean()) < 0.02


def test_quality_learns_from_every_row(spark):
    # More rows than the sample of 6,000 that a model was fitted on once.
    docs = spark.range(0, 6400, numPartitions=6).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), F.col("id") % 7, F.when(F.col("id") % 2 == 0, " good").otherwise(" bad")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(docs, model).join(labels, "doc_id").agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.99
    x = np.stack([quality.features(r.text) for r in docs.select("text").collect()]).astype(np.float64)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-3))  # of all rows


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=30_000) * 5, np.repeat([1.0, 2.0, 1e9], 9000), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "s double")
        for share in (0.0, 0.37, 0.5, 1.0):
            assert np.isclose(quality._quantile(df, share), np.quantile(values, share), rtol=1e-12)
