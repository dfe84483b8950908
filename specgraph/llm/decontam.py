"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is sought by its sketch: the bottom-k MinHash values of its word shingles. The share of an item's sketch that a
document holds estimates the share of the item's shingles that it holds (containment), however long the
document is. Items are partitioned by size, and every partition has the smallest k for which a
contained item cannot escape: of n shingles at most n - ceil(t n) may be absent, so that of
n - ceil(t n) + 1 sketched ones at least one is there. Candidates are verified by exact containment
of the shingles' words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util

#: Shingles of test items that are searched for in one pass over the documents; more items take more passes.
BLOCK_SHINGLES = 2_000_000
#: Size partitions: from one power of this number of shingles to the next.
SIZE_STEP = 1.5
KEPT_WORDS = 300_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    return _WORD.findall(text.lower()) if text else []


class _Hash(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hash()


def forget_words() -> None:
    """Called when a task ends: its worker may go on to other work."""
    _HASHES.clear()


def word_hashes(found: list[str]) -> np.ndarray:
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word's position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class ItemIndex:
    """Sketches of a block of items: sketched shingle hash to items, and each item's shingles."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int, threshold: float):
        self.size, self.threshold = size, threshold
        self.ids, self.shingles, self.hashes = [], [], []
        heads, owners = [], []
        parts: dict[int, list[int]] = {}
        for item, text in zip(ids, texts):
            found = words(text)
            sh = shingle_hashes(word_hashes(found), size)
            if not len(sh):
                continue  # shorter than a shingle: never contained
            k = len(self.ids)
            self.ids.append(item)
            own, first = np.unique(sh, return_index=True)
            self.hashes.append(own)
            self.shingles.append({tuple(found[i : i + size]) for i in first.tolist()})
            parts.setdefault(int(math.log(len(own), SIZE_STEP)), []).append(k)
        for part in parts.values():
            most = max(len(self.hashes[k]) for k in part)
            absent = max(n - math.ceil(threshold * n - 1e-9) for n in range(1, most + 1))
            for k in part:
                sketch = self.hashes[k][: absent + 1]  # hashes ascend: the bottom ones
                heads.append(sketch)
                owners.append(np.full(len(sketch), k))
        every = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], (np.concatenate(owners)[order] if heads else np.zeros(0, np.int64))
        self.filter = np.zeros(1 << 22, dtype=bool)  # most shingles of a document are in no sketch
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, shingles shared, shingles of the item, first word of the first shared shingle, last word of the last one)."""
        found = words(text)
        sh = shingle_hashes(word_hashes(found), self.size)
        hit = sh[self.filter[(sh >> np.uint64(42)).astype(np.int64)]]
        if not len(hit) or not len(self.keys):
            return []
        hit = np.unique(hit)
        lo, hi = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
        cand = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi)] or [[]]).astype(np.int64))
        out = []
        for k in cand.tolist():
            at = np.flatnonzero(np.isin(sh, self.hashes[k]))
            if len(at) < self.threshold * len(self.hashes[k]) - 1e-9:
                continue
            there, own = {}, self.shingles[k]
            for i in at.tolist():
                s = tuple(found[i : i + self.size])
                if s in own:
                    there.setdefault(s, i)
            if len(there) >= self.threshold * len(own) - 1e-9:
                out.append((self.ids[k], len(there), len(own), int(at[0]), int(at[-1]) + self.size - 1))
        return out


def contained(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of document and item of whose distinct word shingles the document holds ``threshold`` or more.

    Returns doc_id, item_id, n_shared, n_shingles, containment, first_word, last_word (positions in the document
    that the shared shingles span). Null, empty and short texts (fewer than ``size`` words) match nothing.
    Rows that repeat an id are searched, and sought, each; equal results appear once. Items are searched for in blocks of at most
    BLOCK_SHINGLES shingles, each of which is small enough to reach every task.
    """
    spark = docs.sparkSession
    _util.tune(spark)
    docs, items = _util.only(docs, "doc_id", "text"), _util.only(items, "item_id", "text").filter("text is not null")
    # A text of n characters has fewer than n shingles.
    weight = int(items.agg(F.sum(F.length("text"))).first()[0] or 0)
    blocks = max(1, math.ceil(weight / (BLOCK_SHINGLES * 2)))
    schema = "doc_id bigint, item_id bigint, n_shared int, n_shingles int, first_word int, last_word int"
    found = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
        search = _searcher(spark.sparkContext.broadcast((part["item_id"].tolist(), part["text"].tolist())), size, threshold)
        one = docs.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _searcher(block, size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*block.value, size, threshold)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in index.search(t)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([cols[i][j] for j in range(len(rows))], k) for i, k in zip((0, 1, 2, 3, 4, 5), kinds)], names=["doc_id", "item_id", "n_shared", "n_shingles", "first_word", "last_word"])
        forget_words()

    return run


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay."""
    bad = contained(docs.filter("doc_id is not null"), items, size, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(_util.read(spark, sf_dir, "documents"), _util.read(spark, sf_dir, "benchmark")).drop("first_word", "last_word")


#: The same by plain SQL over all shingles.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(n_shingles AS INTEGER) AS n_shingles, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
