"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its words; a document's is the
noisy-or of its sentences: one minus the product of their complements. Weights are trained from document
labels alone, through the noisy-or, and then tell which sentences offend.
"""

from __future__ import annotations

import multiprocessing
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util
from .quality import labelled

#: Labelled documents that a model is fitted on, and characters of their texts, at most; documents of these a feature must be in.
SAMPLE, SAMPLE_CHARS, LEAST = 6000, 32_000_000, 8
KEPT_WORDS = 200_000
_ENDS = ".!?⏎"
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "⏎¡¿«»“”"


def tokens(text: str | None) -> list[str]:
    """Lower-case words between white space; a line's end is a token of its own that ends a sentence."""
    return text.lower().replace("\n", " ⏎ ").split() if text else []


def word_features(word: str) -> list[int]:
    """Checksums of the bare word and of its beginnings, which inflected and compounded forms share."""
    bare = word.strip(_EDGE)
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in (bare, *(f"{bare[:k]}*" for k in (3, 4, 5, 6) if len(bare) > k))] if bare else []


class _Codes(dict):
    """Word to twice its number, plus one if it ends a sentence."""

    def __missing__(self, word: str) -> int:
        c = self[word] = 2 * len(self) + (word[-1] in _ENDS)
        return c


class Bags:
    """Texts as sentences, each the set of its words: words (numbers), starts of the sentences among these, sentences of each text.

    bounds: where each sentence starts among the tokens of all texts.
    """

    def __init__(self, texts: list[str | None], codes: _Codes):
        each = [np.fromiter(map(codes.__getitem__, t), dtype=np.int64, count=len(t)) for t in map(tokens, texts)]
        each = [c if len(c) else np.array([codes["⏎"]]) for c in each]  # an empty text is one sentence without words
        flat = np.concatenate(each)
        ends = (flat & 1).astype(bool)
        ends[:-1] &= flat[1:] != codes["⏎"]  # a line's end closes the sentence before it, not an empty one
        ends[np.cumsum([len(c) for c in each]) - 1] = True
        self.bounds = np.append(0, np.flatnonzero(ends)[:-1] + 1)
        doc = np.repeat(np.arange(len(each)), [len(c) for c in each])
        self.doc = doc[self.bounds]
        self.doc_starts = np.searchsorted(self.doc, np.arange(len(each)))
        width = len(codes)
        pair = np.unique((np.cumsum(ends) - ends) * width + (flat >> 1))
        self.words, self.sentence = pair % width, pair // width
        self.starts = np.searchsorted(self.sentence, np.arange(len(self.bounds)))


class Model:
    """Word weights by feature, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))


class Scorer:
    """Applies a model; remembers the weights of words."""

    def __init__(self, model: Model):
        self.model = model
        self._anew()

    def _anew(self) -> None:
        self.codes, self.table = _Codes(), np.zeros(0)

    def sentences(self, texts: list[str | None]) -> tuple[Bags, np.ndarray]:
        if len(self.codes) > KEPT_WORDS:
            self._anew()
        bags = Bags(texts, self.codes)
        if len(self.codes) > len(self.table):
            new = list(self.codes)[len(self.table) :]
            self.table = np.append(self.table, [self.model.word(w) for w in new])
        logit = self.model.bias + np.add.reduceat(self.table[bags.words], bags.starts)
        return bags, logit

    def documents(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        bags, logit = self.sentences(texts)
        return -np.expm1(np.add.reduceat(-np.logaddexp(0, logit), bags.doc_starts))


def fit(texts: list[str | None], label: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-4) -> Model:
    """Minimise the logistic loss of the noisy-or by Adam; weights start at zero, the bias at the base rate.

    Documents of the rarer label count more, up to balance by half. With one label only, the bias alone tells.
    """
    if not len(texts) or label.min() == label.max():
        return Model({}, 5.0 if len(texts) and label.max() == 1 else -12.0)
    codes = _Codes()
    # Sentence and word of every pair of the two, some documents at a time.
    sentence, word, doc, doc_of_pair = [], [], [], []
    for k in range(0, len(texts), 200):
        bags = Bags(texts[k : k + 200], codes)
        sentence.append((bags.sentence + sum(map(len, doc))).astype(np.int32))
        word.append(bags.words.astype(np.int32))
        doc_of_pair.append((bags.doc[bags.sentence] + k).astype(np.int32))
        doc.append((bags.doc + k).astype(np.int32))
    sentence, word, doc, doc_of_pair = map(np.concatenate, (sentence, word, doc, doc_of_pair))
    doc_starts = np.searchsorted(doc, np.arange(len(texts)))
    found, width = array("Q"), array("B")
    for w in codes:
        ids = word_features(w)
        found.extend(ids)
        width.append(len(ids))
    width = np.frombuffer(width, dtype=np.uint8).astype(np.int32)
    names, feature_at = np.unique(np.frombuffer(found, dtype=np.uint64), return_inverse=True)
    feature_at, found = feature_at.astype(np.int32), None
    begin = np.cumsum(width) - width
    # Documents that each feature is in, and those of label 1 among them.
    df, bad = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    cuts = np.searchsorted(doc_of_pair, np.arange(0, len(texts) + 200, 200))
    for x, y in zip(cuts, cuts[1:]):
        pair = np.unique(doc_of_pair[x:y].astype(np.int64) * len(codes) + word[x:y])
        own, count = pair % len(codes), width[pair % len(codes)].astype(np.int64)
        shift = begin[own] - (np.cumsum(count) - count)
        seen = np.unique(np.repeat(pair // len(codes), count) * len(names) + feature_at[np.repeat(shift, count) + np.arange(count.sum())])
        df += np.bincount(seen % len(names), minlength=len(names))
        bad += np.bincount((seen % len(names))[label[seen // len(names)] == 1], minlength=len(names))
    rate1 = label.mean()
    # Features that are no commoner among label 1 than elsewhere cannot raise a sentence: they get no weight.
    use = (df >= LEAST) & (bad > 1.2 * rate1 * df)
    place = np.cumsum(use) - 1
    keep = use[feature_at]
    word_at, feature_at = np.repeat(np.arange(len(codes), dtype=np.int32), width)[keep], place[feature_at[keep]]
    m = int(use.sum())
    # Only words with such features tell sentences apart.
    active = np.zeros(len(codes), dtype=bool)
    active[word_at] = True
    on = active[word]
    sentence, word, doc_of_pair = sentence[on], word[on], None
    n_sent = np.diff(np.append(doc_starts, len(doc)))
    bias = float(np.log(np.expm1(-np.log1p(-rate1 / 2) / np.median(n_sent)) + 1e-12))
    w = np.zeros(m + 1)
    w[m] = bias
    importance = np.where(label == 1, np.sqrt((1 - rate1) / rate1), 1.0)
    importance /= importance.mean()
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        table = np.bincount(word_at, weights=w[feature_at], minlength=len(codes))
        logit = w[m] + np.bincount(sentence, weights=table[word], minlength=len(doc))
        none = np.add.reduceat(-np.logaddexp(0, logit), doc_starts)  # log of the chance that no sentence offends
        p = -np.expm1(none)
        # d loss / d none: for label 0 the loss is -none, for label 1 -log(1 - exp(none)).
        pull = np.where(label == 1, np.exp(none) / np.maximum(p, 1e-9), -1.0) * importance
        by_sentence = -pull[doc] / (1 + np.exp(-np.clip(logit, -500, 500)))
        g_word = np.bincount(word, weights=by_sentence[sentence], minlength=len(codes))
        g = np.append(np.bincount(feature_at, weights=g_word[word_at], minlength=m), by_sentence.sum()) / len(label)
        g[:m] += penalty * w[:m]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model({int(n): float(x) for n, x in zip(names[use], w[:m]) if abs(x) > 1e-3}, float(w[m]))


def fit_apart(texts: list[str | None], label: np.ndarray) -> Model:
    """``fit`` in a process of its own, so that a worker that goes on keeps none of the memory that it takes."""
    fork = multiprocessing.get_context("fork")
    ours, theirs = fork.Pipe(duplex=False)

    def work() -> None:
        model = fit(texts, label)
        theirs.send((model.weights, model.bias))

    child = fork.Process(target=work)
    child.start()
    theirs.close()
    try:
        return Model(*ours.recv())
    except EOFError:
        raise RuntimeError("the fit ended without a result") from None
    finally:
        child.join()


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled documents for which ``train_rows`` (a condition on doc_id) holds: at most ``sample`` of them, and of these, by the hash of their ids, those whose whole texts fit into ``chars``.

    The fit is one task of bounded size on an executor; the driver gets the weights. A document with several labels has the largest; null labels
    and others than 0 and 1 don't count; rows that repeat an id are learned from each. Without any labelled text every text is clean.
    """
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], chars
        for b in batches:
            for doc_id, text, mark in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label"))):
                if len(text or "") <= left:
                    rows.append((doc_id, text, mark))
                    left -= len(text or "")
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        model = fit_apart([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64))
        names = [None, *model.weights]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["feature", "weight"])

    one = labelled(docs, labels, label, train_rows, sample).select("doc_id", "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    found = one.mapInArrow(run, "feature bigint, weight double").collect()
    return Model({r.feature: r.weight for r in found if r.feature is not None}, next((r.weight for r in found if r.feature is None), -12.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the score of one sentence without words. Repeated rows are scored each."""
    spark = docs.sparkSession
    _util.tune(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            made = scorer.documents(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.float64())], names=["doc_id", "score"])

    return _util.only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, score, sentence): sentences with a probability of ``least`` or more, numbered from 0; words in lower case, joined by spaces."""
    spark = docs.sparkSession
    _util.tune(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        kept = pa.schema([("doc_id", pa.int64()), ("sentence_no", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())])
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                bags, logit = scorer.sentences([text])
                words = tokens(text)
                ends = np.append(bags.bounds[1:], max(len(words), 1))
                for k in np.flatnonzero(1 / (1 + np.exp(-logit)) >= least).tolist():
                    own = [w for w in words[bags.bounds[k] : ends[k]] if w != "⏎"]
                    rows.append({"doc_id": doc_id, "sentence_no": k, "score": float(1 / (1 + np.exp(-logit[k]))), "sentence": " ".join(own)})
            yield pa.RecordBatch.from_pylist(rows, schema=kept)

    return _util.only(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, sentence_no int, score double, sentence string")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``least`` or more; all columns stay, rows without an id too."""
    spark = docs.sparkSession
    _util.tune(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array(scorer.documents(b.column("text").to_pylist()) < least))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _util.read(spark, sf_dir, "documents"), _util.read(spark, sf_dir, "labels")
    rest = _util.crc_rest(F.col("doc_id"), 5)
    model = train(docs, labels, rest != 0)
    return score(docs, model).select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
