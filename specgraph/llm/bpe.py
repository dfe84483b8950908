"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces (matches of the pre-tokenising pattern) of many documents form one
corpus of byte sequences. An inverted index keeps, for every rank, the positions of the adjacent
pairs with that rank. Ranks are taken in ascending order; all positions of a rank
are merged at once, and only the pairs with the touched neighbours enter the index anew.
Pieces that are known already are looked up; documents are then put together by gathering.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util

#: Characters of text whose pieces are replayed together, and pieces kept before a worker starts anew.
CORPUS_CHARS = 3_000_000
KEPT_PIECES = 400_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a ``.tiktoken`` file (ids are ranks)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class MergeTable:
    """Every way to make a token out of two others, as sorted keys for vectorised look-up."""

    def __init__(self, vocab: list[bytes]):
        rank = {t: i for i, t in enumerate(vocab) if t}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, i in rank.items():
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**62))
        self.made = np.append(np.array(made, dtype=np.int64)[order], np.int64(-1))
        self.vocab = vocab

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 where it makes none (ids of -1 never do)."""
        key = left << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)


def replay(pieces: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in a row, number of ids per piece), merging in rank order over all pieces at once."""
    lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    total = int(lens.sum())
    owner = np.repeat(np.arange(len(pieces)), lens)
    token = table.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    # Doubly linked positions; total stands for "none" and holds token -1.
    token = np.append(token, -1)
    last = np.zeros(total + 1, dtype=bool)
    first = np.zeros(total + 1, dtype=bool)
    ends = np.cumsum(lens)
    full = lens > 0
    last[ends[full] - 1] = True
    first[ends[full] - lens[full]] = True
    nxt = np.append(np.arange(1, total + 1), total)
    prv = np.append(np.arange(-1, total - 1), total)
    nxt[:total][last[:total]] = total
    prv[:total][first[:total]] = total
    # pair_rank[i]: rank of the pair that starts at position i, the index's truth; stale entries disagree with it.
    pair_rank = np.full(total + 1, -1, dtype=np.int64)
    pair_rank[:total] = table.ranks_of(token[:total], token[nxt[:total]])
    live = np.flatnonzero(pair_rank >= 0)
    order = np.argsort(pair_rank[live], kind="stable")
    by_rank, live = pair_rank[live][order], live[order]
    cuts = np.flatnonzero(np.diff(by_rank, prepend=-1))
    index: dict[int, list[np.ndarray]] = {int(by_rank[c]): [p] for c, p in zip(cuts, np.split(live, cuts[1:]))}
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.sort(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[pair_rank[at] == rank]
        if len(at) > 1:
            at = _leftmost(at, nxt)
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        token[at] = rank
        token[gone] = -1
        nxt[at] = after
        prv[after] = at
        prv[total] = total
        pair_rank[gone] = -1
        before = prv[at]
        new = np.concatenate((at, before[before < total]))
        ranks = table.ranks_of(token[new], token[nxt[new]])
        pair_rank[new] = ranks
        ok = ranks >= 0
        if ok.any():
            new, ranks = new[ok], ranks[ok]
            if len(new) > 1:
                order = np.lexsort((new, ranks))
                new, ranks = new[order], ranks[order]
                keep = np.append(True, (np.diff(new) != 0) | (np.diff(ranks) != 0))
                new, ranks = new[keep], ranks[keep]
                cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
                groups = zip(ranks[cuts].tolist(), np.split(new, cuts[1:]))
            else:
                groups = [(int(ranks[0]), new)]
            for r, p in groups:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)
    left = token[:total] >= 0
    return token[:total][left].astype(np.int32), np.bincount(owner[left], minlength=len(pieces)).astype(np.int32)


def _leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of chains of overlapping pairs (a run of one token) every other one, from the left."""
    at = np.unique(at)
    chained = np.append(False, nxt[at[:-1]] == at[1:])
    if not chained.any():
        return at
    run = np.cumsum(~chained)
    start = np.flatnonzero(~chained)
    return at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]


class _Index(dict):
    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        return i


class Encoder:
    """Texts to ids; knows pieces from earlier texts."""

    def __init__(self, vocab: list[bytes], pattern: str):
        import regex

        self.table, self.find = MergeTable(vocab), regex.compile(pattern).findall
        self._anew()

    def _anew(self) -> None:
        self.index, self.known = _Index(), 0
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids per text)."""
        if len(self.index) > KEPT_PIECES:
            self._anew()
        docs = []
        for t in texts:
            found = self.find(t) if t else []
            docs.append(np.fromiter(map(self.index.__getitem__, found), dtype=np.int32, count=len(found)))
        if len(self.index) > self.known:
            new = [p.encode("utf-8", "surrogatepass") for p in list(self.index)[self.known :]]
            flat, count = replay(new, self.table)
            begin = np.cumsum(count, dtype=np.int64) - count + len(self.flat)
            self.flat = np.concatenate((self.flat, flat))
            self.start, self.count = np.concatenate((self.start, begin)), np.concatenate((self.count, count))
            self.known = len(self.index)
        sizes = np.fromiter((int(self.count[d].sum()) for d in docs), dtype=np.int64, count=len(docs))
        every = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        return gather(self.flat, self.start[every], self.count[every]), sizes


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start : start + count] for each, in a row."""
    count = count.astype(np.int64)
    total = int(count.sum())
    shift = start - (np.cumsum(count) - count)
    return flat[np.repeat(shift, count) + np.arange(total)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, so that its pieces serve later tasks too."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an ``array<int>`` column of token ids, without special tokens.

    Null and empty texts get an empty array. Other columns stay as they are; a column already named as
    ``ids`` is replaced. Repeated rows are encoded each. ``path`` names a vocabulary file that
    every executor can read.
    """
    _util.tune(docs.sparkSession)
    docs = docs.drop(ids) if ids != text else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, chars = encoder(path, pattern), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [x or "" for b in held for x in b.column(text).to_pylist()]
            flat, sizes = enc.encode(texts)
            ends, row = np.append(0, np.cumsum(sizes)), 0
            for b in held:
                offs = ends[row : row + b.num_rows + 1]
                values = pa.array(flat[offs[0] : offs[-1]], type=pa.int32())
                made = pa.ListArray.from_arrays(pa.array((offs - offs[0]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, ids])
                row += b.num_rows

        for b in batches:
            held.append(b)
            chars += b.column(text).nbytes
            if chars >= CORPUS_CHARS:
                yield from flush()
                held, chars = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a binary column of the bytes that the ids stand for; null ids give null, unknown ids an error."""
    _util.tune(docs.sparkSession)
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load_ranks(path)
        flat = np.frombuffer(b"".join(vocab), dtype=np.uint8)
        count = np.fromiter(map(len, vocab), dtype=np.int64, count=len(vocab))
        start = np.cumsum(count) - count
        for b in batches:
            lists = b.column(ids)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values) and (values.min() < 0 or values.max() >= len(vocab)):
                raise ValueError("an id is outside the vocabulary")
            data = gather(flat, start[values], count[values]).tobytes()
            sizes = np.append(0, np.cumsum(count[values]))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = sizes[np.append(0, np.cumsum(n))]
            nulls = lists.is_null().to_pylist()
            made = pa.array([None if z else data[a:e] for z, a, e in zip(nulls, ends[:-1], ends[1:])], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: an encode and decode round trip."""
    coded = encode(_util.only(docs, "doc_id", "text"), path, pattern).drop("text")
    back = decode(coded, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(_util.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
