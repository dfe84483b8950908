"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. All labelled documents go into preference pairs (one
labelled 1 beside one labelled 0): each of the label that has more of them meets one of the other, dealt out in turn. The strengths minimise the logistic loss of the
feature differences. The threshold is the quantile of all training strengths that leaves the share of label 1 above it;
the score is a logistic function of the distance to it. A fit goes over stored features again and again; every pass leaves sums of fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _util

#: Number of features.
WIDTH = 276
#: Rows of the rarer label that go to every task; more are dealt out.
SPREAD = 1000
#: Bins that a pass over strengths counts, and values that are few enough to be sorted at once.
BINS, FEW = 4096, 10_000


def features(text: str | None) -> np.ndarray:
    """Byte shares and measures of words, lines and repetition."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    share = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / n
    words = text.split()
    m = max(len(words), 1)
    kinds = Counter(words)
    lines = text.split("\n")
    top = kinds.most_common(3)
    same = sum(map(str.__eq__, words, words[1:])) / m
    other = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m, len(kinds) / m, np.log(len(kinds) + 1) / np.log(m + 1.5), sum(c for _, c in top) / m, (top[0][1] if top else 0) / m, same,
        len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines) / 1000, float(share[65:91].sum()), float(share[97:123].sum()), float(share[48:58].sum()), float(share[33:48].sum()), float(share[58:65].sum()), float(share[91:97].sum()), float(share[123:127].sum()), float(share[128:].sum()),
        float(not words),
    ])
    return np.concatenate((np.sqrt(share), other)).astype(np.float32)


class Ranker:
    """Strength, threshold and score of feature rows."""

    def __init__(self, mean, scale, weights, threshold, slope):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold), -500, 500)))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, curvature and number of the rows of the logistic loss of x w against y in {-1, 1}, in a row."""
    p = 1 / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))
    return np.concatenate((-(x * (y * p)[:, None]).sum(axis=0), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [float(len(x))]))


def _logistic(sums: Callable[[np.ndarray], np.ndarray], width: int, penalty: float, steps: int) -> np.ndarray:
    """Weights that minimise the mean logistic loss, by Newton's method; ``sums`` makes a pass over all rows."""
    w = np.zeros(width)
    for _ in range(steps):
        s = sums(w)
        gradient = s[:width] / s[-1] + penalty * w
        curve = s[width:-1].reshape(width, width) / s[-1] + penalty * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _single(width: int, label: int) -> Ranker:
    """With one label only, every document gets that label's side of 0.5; 0 without any."""
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if label else 1.0, 1.0)


def fit(x: np.ndarray, label: np.ndarray) -> Ranker:
    """Learn from features and 0/1 labels that are at hand; pairs as in ``train``, in the order of the rows."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    width = x.shape[1] if x.ndim == 2 else WIDTH
    if not len(good) or not len(bad):
        return _single(width, len(good))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = _standard(x, mean, scale)
    n = max(len(good), len(bad))
    pairs = z[np.resize(good, n)] - z[np.resize(bad, n)]
    w = _logistic(lambda w: _sums(pairs, np.ones(n), w), width, 1e-3, 12)
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / len(label)))
    y = np.where(label == 1, 1.0, -1.0)
    slope = float(_logistic(lambda w: _sums((s - threshold)[:, None], y, w), 1, 1e-4, 30)[0])
    return Ranker(mean, scale, w, threshold, max(slope, 1e-3))


def _known(labels: DataFrame, label: str, train: DataFrame) -> DataFrame:
    """(doc_id, label) of all labelled training documents."""
    return _util.only(labels, "doc_id", label).filter(F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(F.max(label).alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled training rows, chosen by the hash of their ids; sent out to the documents."""
    some = _known(labels, label, train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return _util.only(docs, "doc_id", "text").join(F.broadcast(some), "doc_id")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), -1).astype(np.float64)


def _total(rows: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``made`` gives for all batches: summed up in each task, then in one task that holds a sum at a time."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = made(b)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("s").to_pylist():
                s = np.frombuffer(v)
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = rows.mapInArrow(part, "s binary").repartition(1).mapInArrow(whole, "s binary")
    return np.frombuffer(sums.first()[0])


def _quantile(strengths: DataFrame, share: float) -> float:
    """The quantile of column s over all rows, between two values as numpy's: bins are counted and narrowed until few values are left."""
    n, low, high = strengths.agg(F.count("*"), F.min("s"), F.max("s")).first()
    at = (n - 1) * share

    def value(k: int) -> float:
        a, b, before, inside = low, high, 0, n
        while inside > FEW and a < b:
            width = (b - a) / BINS
            if not a + width > a:
                break  # the values are next to each other
            bin_ = F.least(F.floor((F.col("s") - a) / width), F.lit(BINS - 1)).alias("bin")
            some = strengths.filter(F.col("s").between(a, b)).groupBy(bin_).agg(F.count("*").alias("c"), F.min("s").alias("a"), F.max("s").alias("b"))
            for r in sorted(some.collect()):
                if k - before < r.c:
                    a, b, inside = r.a, r.b, r.c
                    break
                before += r.c
        if a == b:
            return a
        return sorted(r.s for r in strengths.filter(F.col("s").between(a, b)).select("s").collect())[k - before]

    least = value(int(at))
    return least + (at - int(at)) * ((value(min(int(at) + 1, n - 1)) if at > int(at) else least) - least)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _pairs(rows: DataFrame, count: dict[int, int], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(d): differences of standardised features, label 1 less label 0; rows (label, x, task, at) of the label that has more are dealt out in turn over those of the other."""
    of = ["task", "label"]
    sizes = rows.groupBy(*of).agg(F.count("*").alias("n"))  # two rows a task
    starts = sizes.select(*of, (F.sum("n").over(W.partitionBy("label").orderBy("task")) - F.col("n")).alias("start"))
    placed = rows.join(F.broadcast(starts), of).withColumn("k", F.col("start") + F.col("at"))
    few = 0 if count[0] < count[1] else 1
    small = placed.filter(F.col("label") == few).select("k", F.col("x").alias("b"))
    large = placed.filter(F.col("label") == 1 - few).select((F.col("k") % count[few]).alias("k"), F.col("x").alias("a"))
    sign = 1.0 if few == 0 else -1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = (sign * (_standard(_vectors(b.column("a")), mean, scale) - _standard(_vectors(b.column("b")), mean, scale))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in d], pa.binary())], names=["d"])

    # Where few rows are dealt out many times they go to every task, so that none meets them all.
    return large.join(F.broadcast(small) if count[few] <= SPREAD else small, "k").select("a", "b").mapInArrow(run, "d binary")


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "quality") -> Ranker:
    """Fit on all labelled documents for which ``train_rows`` (a condition on doc_id) holds; their features are written out once."""
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "x"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0, 0]
        for b in batches:
            given, at = b.column("label").to_numpy(), np.zeros(b.num_rows, np.int64)
            for y in (0, 1):
                mine = given == y
                at[mine] = seen[y] + np.arange(mine.sum())
                seen[y] += int(mine.sum())
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("x"), pa.array(at)], names=["label", "x", "at"])

    # Texts stay where they are: a filter by hash tells most that have no label, and the join is of features.
    known = _known(labels, label, train_rows).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    maybe, name = _util.among(known, F.xxhash64("doc_id"))
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(maybe).mapInArrow(run, "doc_id bigint, x binary").join(known, "doc_id").select("label", "x")
    rows = _util.cut(some.mapInArrow(numbered, "label int, x binary, at bigint").withColumn("task", F.spark_partition_id()), "quality-features")
    _util.forget(docs.sparkSession, name)
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        _util.drop(rows)
        return _single(WIDTH, max(count, default=0))
    n = sum(count.values())
    mean = _total(rows, lambda b: _vectors(b.column("x")).sum(axis=0)) / n
    scale = np.maximum(np.sqrt(_total(rows, lambda b: ((_vectors(b.column("x")) - mean) ** 2).sum(axis=0)) / n), 1e-3)
    pairs = _util.cut(_pairs(rows, count, mean, scale), "quality-pairs")
    w = _logistic(lambda w: _total(pairs, lambda b: _sums(_vectors(b.column("d")), np.ones(b.num_rows), w)), WIDTH, 1e-3, 12)
    _util.drop(pairs)

    def strength(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_standard(_vectors(b.column("x")), mean, scale) @ w), pa.array(b.column("label").to_numpy() * 2.0 - 1)], names=["s", "y"])

    found = _util.cut(rows.select("label", "x").mapInArrow(strength, "s double, y double"), "quality-strengths")
    _util.drop(rows)
    threshold = _quantile(found, count[0] / n)
    far = F.col("s") - threshold

    def sums(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + F.exp(F.greatest(F.least(F.col("y") * far * float(w[0]), F.lit(30.0)), F.lit(-30.0))))
        return np.array(found.agg(F.sum(-far * F.col("y") * p), F.sum(far * far * p * (1 - p)), F.count("*")).first(), dtype=np.float64)

    slope = float(_logistic(sums, 1, 1e-4, 30)[0])
    _util.drop(found)
    return Ranker(mean, scale, w, threshold, max(slope, 1e-3))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score) of every whole text; null texts count as empty, repeated rows are scored each."""
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([features(t) for t in b.column("text").to_pylist()]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return _util.only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _util.read(spark, sf_dir, "documents"), _util.read(spark, sf_dir, "labels")
    rest = _util.crc_rest(F.col("doc_id"), 3)
    model = train(docs, labels, rest != 1)
    return score(docs, model).select("doc_id", (rest == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
