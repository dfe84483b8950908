"""Language-model scoring by deleted interpolation.

Maximum-likelihood n-gram estimates are mixed order by order: each is mixed with the mixture of the shorter ones, by a weight that depends
on how often its context was seen (buckets of half powers of two). Weights come from expectation-maximisation on held-out counts: each training
token in turn is held out, that is, taken off the counts that predict it. Training texts are scored in the same way, so that
a text's own words don't vouch for it and its score can be held against that of any other.

Texts are cut into chunks of bounded size. A chunk holds its distinct words (as 64-bit hashes) and
the sequence of their positions. Counts are exchanged once per order: each chunk sends, for its distinct n-grams,
its own training counts to the bucket of the n-gram's hash, and gets back the corpus totals in the
same order. N-grams are summed within the chunk first, so that however frequent one is, a chunk sends it once. The number of buckets
follows from the bytes that they get.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

#: Words of the longest n-grams of ``query``.
ORDER = 3
#: Characters in a chunk (one longer text makes a chunk of its own), and bytes of n-gram hashes in a bucket, about.
CHUNK_CHARS, BUCKET_BYTES = 4_000_000, 8_000_000
END, BOS = 1, 2
#: Cells of the held-out statistics: steps per factor of two in a likelihood ratio, and their number; buckets of context counts.
STEPS, CELLS, CONTEXTS = 8, 768, 96


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def words(text: str | None) -> list[bytes]:
    """Tokens without the end: runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def chunked(docs: DataFrame) -> DataFrame:
    """A row per chunk: doc_ids, held (held-out flags), lens (tokens with the end), vocab (hashes), seq (indexes into it)."""
    _util.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, k = TaskContext.get().partitionId() << 32, 0

        def flush() -> pa.RecordBatch:
            vocab = np.array([END, BOS] + [xxhash.xxh3_64_intdigest(w) for w in list(index)[2:]], dtype=np.uint64)
            row = {"chunk": part | k, "doc_ids": ids, "held": held, "lens": [len(s) for s in seqs], "vocab": vocab.tobytes(), "seq": zlib.compress(np.concatenate(seqs).tobytes(), 1)}
            return pa.RecordBatch.from_pylist([row], schema=kept)

        def fresh():
            return _Index({b" end": 0, b" bos": 1}), [], [], [], 0  # no word holds a space

        index, ids, held, seqs, chars = fresh()
        for b in batches:
            for doc_id, text, out in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("held").to_pylist()):
                found = words(text)
                seq = np.zeros(len(found) + 1, dtype=np.uint32)
                seq[:-1] = np.fromiter(map(index.__getitem__, found), dtype=np.uint32, count=len(found))
                ids.append(doc_id), held.append(out), seqs.append(seq)
                chars += len(text or "")
                if chars >= CHUNK_CHARS:
                    yield flush()
                    k += 1
                    index, ids, held, seqs, chars = fresh()
        if ids:
            yield flush()

    kept = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("vocab", pa.binary()), ("seq", pa.binary())])
    return docs.select("doc_id", "text", "held").mapInArrow(run, "chunk bigint, doc_ids array<bigint>, held array<boolean>, lens array<int>, vocab binary, seq binary")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a gram and the word after it."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Chunk:
    """One chunk's sequence: gram hashes of each order by position."""

    def __init__(self, row):
        self.doc_ids, self.held, self.lens = list(row.doc_ids), np.array(row.held, dtype=bool), np.array(row.lens, dtype=np.int64)
        self.vocab = np.frombuffer(row.vocab, dtype=np.uint64)
        self.seq = np.frombuffer(zlib.decompress(row.seq), dtype=np.uint32)
        self.train = np.repeat(~self.held, self.lens)
        self.starts = np.cumsum(self.lens) - self.lens

    def before(self, x: np.ndarray, at_start) -> np.ndarray:
        """x of the position before, at_start at the beginning of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = at_start
        return out

    def grams(self, order: int) -> np.ndarray:
        g = self.vocab[self.seq]
        word, start = g, np.uint64(BOS)
        for _ in range(order - 1):
            g = _mix(self.before(g, start), word)
            start = _mix(np.array([start]), np.array([BOS], dtype=np.uint64))[0]
        return g

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct grams in ascending order, each position's place among them, training counts)."""
        if order == 1:
            place = np.argsort(self.vocab, kind="stable")
            rank = np.empty_like(place)
            rank[place] = np.arange(len(place))
            at = rank[self.seq]
            return self.vocab[place], at, np.bincount(at[self.train], minlength=len(place))
        keys, at = np.unique(self.grams(order), return_inverse=True)
        return keys, at, np.bincount(at[self.train], minlength=len(keys))


def totals(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(chunk, bucket, totals): corpus training counts of each chunk's distinct grams, part by part in ascending key order.

    Rows with chunk -1 carry a bucket's training tokens and distinct training grams.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
        for frame in frames:
            for row in frame.itertuples():
                keys, _, counts = Chunk(row).keys(order)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                parts = [(b, row.chunk, keys[x:y].tobytes(), zlib.compress(counts[x:y].astype(np.int32).tobytes(), 1)) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                yield pd.DataFrame(parts, columns=["bucket", "chunk", "keys", "counts"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, dtype=np.uint64) for x in frame["keys"]]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.int32) for x in frame["counts"]])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        each = np.split(total[at], ends[:-1])
        rows = [(c, key[0], zlib.compress(x.tobytes(), 1), 0, 0) for c, x in zip(frame["chunk"], each)]
        return pd.DataFrame([*rows, (-1, key[0], b"", int(total.sum()), int((total > 0).sum()))], columns=["chunk", "bucket", "totals", "tokens", "types"])

    sent = chunks.mapInPandas(send, "bucket int, chunk bigint, keys binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(add, "chunk bigint, bucket int, totals binary, tokens bigint, types bigint")


def _per_chunk(chunks: DataFrame, counts: DataFrame, order: int, each, schema: str) -> DataFrame:
    """each(Chunk, [counts of order 1, ..]) for every chunk, with the corpus counts by position."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples():
            chunk, by = Chunk(row), []
            for k in range(1, order + 1):
                own = right[right["order"] == k].sort_values("bucket")
                found = np.concatenate([np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in own["totals"]])
                by.append(found[chunk.keys(k)[1]])
            made.append(each(chunk, by))
        return pd.concat(made)

    return chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInPandas(run, schema)


def _context(chunk: Chunk, counts: list[np.ndarray], k: int, texts: int) -> np.ndarray:
    """How often the k-1 words before each position occur as a context in training."""
    return chunk.before(counts[k - 2], texts)  # every gram but those that close a text is followed by a word


class Mixture:
    """The estimates of a chunk's positions, order by order."""

    def __init__(self, tokens: int, types: int, texts: int, weights: list[np.ndarray] | None = None):
        self.tokens, self.types, self.texts, self.weights = tokens, types, texts, weights or []

    def step(self, chunk: Chunk, by: list[np.ndarray], k: int, less) -> tuple[np.ndarray, np.ndarray]:
        """(context bucket, estimate of order k) by position, with ``less`` (0 or 1, or one of them for each position) taken off the counts."""
        seen = np.maximum((np.full(len(by[0]), self.tokens) if k == 1 else _context(chunk, by, k, self.texts)) - less, 0)
        return (2 * np.log2(seen + 1)).astype(np.int64), np.maximum(by[k - 1] - less, 0) / np.maximum(seen, 1)

    def mixed(self, chunk: Chunk, by: list[np.ndarray], less) -> np.ndarray:
        """The mixture of all orders whose weights are known."""
        p = np.full(len(by[0]), 1 / (self.types + 1))
        for k, w in enumerate(self.weights, 1):
            bucket, estimate = self.step(chunk, by, k, less)
            p += w[bucket] * (estimate - p)
        return p


def fit(chunks: DataFrame, parts: list[DataFrame], mixture: Mixture, rounds: int = 100) -> None:
    """Learn the weights of the orders in turn, from 1 up, each with those below it fixed.

    Only counts of cells (context bucket, ratio of the order's held-out estimate to the mixture below) reach the driver; their
    number has a fixed bound. A context that was never seen has the weight 0.
    """
    for k in range(1, len(parts) + 1):

        def each(chunk: Chunk, by: list[np.ndarray], k: int = k) -> pd.DataFrame:
            bucket, estimate = mixture.step(chunk, by, k, 1)
            use = chunk.train
            ratio = (estimate / mixture.mixed(chunk, by, 1))[use]
            level = np.where(ratio > 0, 1 + np.clip(np.rint(np.log2(np.maximum(ratio, 1e-300)) * STEPS) + CELLS // 4, 0, CELLS - 2), 0)
            cell, n = np.unique(bucket[use] * CELLS + level.astype(np.int64), return_counts=True)
            return pd.DataFrame({"cell": cell, "n": n})

        cells = _util.cut(_per_chunk(chunks, _together(parts[:k]), k, each, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells")
        found = cells.toPandas()
        _util.drop(cells)
        cell, n = found["cell"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=float)
        bucket, level = cell // CELLS, cell % CELLS
        ratio = np.where(level > 0, 2.0 ** ((level - 1 - CELLS // 4) / STEPS), 0.0)
        total = np.bincount(bucket, weights=n, minlength=CONTEXTS)
        w = np.full(CONTEXTS, 0.5)
        for _ in range(rounds):  # one count for and against keeps every weight between 0 and 1
            w = (1 + np.bincount(bucket, weights=n * w[bucket] * ratio / (w[bucket] * ratio + 1 - w[bucket]), minlength=CONTEXTS)) / (2 + total)
        w[0] = 0.0
        mixture.weights = [*mixture.weights, w]


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("chunk >= 0").select("chunk", "bucket", "totals", "order")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Base and model scores of every text; ``docs`` has doc_id, text and held (true: kept out of training).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, whole_score. ``score`` takes each token of a training text
    off the counts that predict it; ``whole_score`` does not. Null texts count as empty: they consist of the end
    alone. Null ids stay null; repeated rows are scored, and learned from, each. Without training texts every word is unknown and
    the score is that of the uniform estimate. An empty table gives no rows.
    """
    chunks = _util.cut(chunked(docs), "lm-chunks")
    texts = docs.filter(~F.col("held")).count()
    size = chunks.agg(F.sum(F.octet_length("vocab")).alias("words"), F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, n: a + n) * 8).alias("grams")).first()
    parts = []
    for k in range(1, order + 1):
        most = (size.words if k == 1 else size.grams) or 0  # of the hashes that chunks send
        buckets = max(16, math.ceil(most / BUCKET_BYTES))
        parts.append(_util.cut(totals(chunks, k, buckets).withColumn("order", F.lit(k)), f"lm-counts{k}"))
    row = parts[0].filter("chunk = -1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = int(row.n or 0), int(row.v or 0)
    mixture = Mixture(tokens, types, texts)
    fit(chunks, parts, mixture)

    def each(chunk: Chunk, by: list[np.ndarray]) -> pd.DataFrame:
        base = np.log10((by[0] + 1) / (tokens + types + 1))
        at = chunk.starts
        return pd.DataFrame({
            "doc_id": pd.array(chunk.doc_ids, dtype="Int64"), "held_out": chunk.held, "n_tokens": chunk.lens, "n_known": np.add.reduceat((by[0] > 0).astype(np.int64), at), "train_tokens": tokens,
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(mixture.mixed(chunk, by, chunk.train.astype(np.int64))), at), "whole_score": np.add.reduceat(np.log10(mixture.mixed(chunk, by, 0)), at),
        })

    out = _util.cut(_per_chunk(chunks, _together(parts), order, each, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, whole_score double"), "lm-scores")
    _util.drop(chunks, *parts)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _util.read(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (_util.crc_rest(F.col("doc_id"), 7) == 2).alias("held")))
