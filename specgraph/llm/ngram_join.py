"""Near-duplicate documents by Jaccard similarity of word shingles: a MinHash LSH forest and exact verification.

A forest has TREES tries. In each, documents stand sorted by a signature of DEPTH MinHash values of its own; those that
share a prefix are neighbours there and share a node. Matching starts at whole signatures, and the prefixes
are shortened, one tree at a time, until the recall reaches the target: that of the collision model, and that
measured on sampled documents whose pairs are known by their exact Jaccard similarity. A node's documents are found
by grouping on the prefix: the runs of equal prefixes that sorting gives, but summed up before the shuffle, so that
a run that holds a third of all documents never meets in one task.
Documents that share a node in any tree are candidates. What candidates connect is verified exactly, all pairs
of a block of bounded size at once; larger sets are cut into blocks by size and hash, and every
pair of blocks that can hold a link is one task. Documents with equal shingle sets are one class and verified once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _util
from .components import components
from .decontam import forget_words, shingle_hashes, word_hashes, words

TREES, DEPTH = 20, 5
#: Documents (those with the smallest hashes of their ids) whose pairs with all others are sought, and pairs of each (again by hash) that are audited.
AUDITED, PARTNERS = 256, 8
#: By so much may the share of equal MinHash values fall short of the threshold in a pair whose exact similarity is asked for (five standard deviations).
SLACK = 0.2
#: Weight of a verification block: shingles, and so many more per document.
BLOCK, PER_DOC = 2_000_000, 1000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words(text)), size))


def _perms() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(shingles: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values (upper 32 bits of a multiply-add hash)."""
    a, b = perms
    low = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 512):
            x = shingles[k : k + 512]
            x = x ^ (x >> np.uint64(31))
            np.minimum(low, (a[:, None] * x + b[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, cls, n, sig): digest, size and MinHash signature of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = _perms()
        for b in batches:
            cls, n, sig = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                cls.append(_digest(s) if len(s) else None)
                sig.append(signature(s, perms) if len(s) else np.zeros(TREES * DEPTH, np.int32))
            flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * (TREES * DEPTH)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), lists], names=["doc_id", "cls", "n", "sig"])
        forget_words()

    return docs.mapInArrow(run, "doc_id bigint, cls binary, n bigint, sig array<int>")


def exact_sets(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (text, cls, and other columns) with the shingles' hashes in place of text and cls; rows whose text is not of that class go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column("text").to_pylist()]
            own = [_digest(s) == c for s, c in zip(sets, b.column("cls").to_pylist())]  # rows may repeat an id with other texts
            names = [x for x in b.schema.names if x not in ("text", "cls")]
            batch = pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
            yield batch.filter(pa.array(own, pa.bool_()))
        forget_words()

    names = [c for c in docs.columns if c not in ("text", "cls")]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "cls", "text").mapInArrow(run, f"{schema}, shingles binary")


def audited(docs: DataFrame, reps: DataFrame, size: int, threshold: float) -> np.ndarray:
    """Values that the pairs of sampled documents share from the start, [pair, tree]; pairs with an exact similarity of ``threshold`` or more."""
    spark = reps.sparkSession
    rows = reps.orderBy(F.xxhash64("rep"), "rep").limit(AUDITED).select("rep", "sig").collect()
    if not rows:
        return np.zeros((0, TREES), dtype=np.int32)
    sample = spark.sparkContext.broadcast((np.array([r.rep for r in rows]), np.array([r.sig for r in rows], dtype=np.int32)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs = sample.value
        for b in batches:
            own = b.column("rep").to_numpy()
            have = b.column("sig").flatten().to_numpy().reshape(len(own), -1)
            q, rep, common = [], [], []
            for i, s in zip(ids, sigs):
                same = have == s
                like = np.flatnonzero((same.mean(axis=1) >= threshold - SLACK) & (own != i))
                q += [i] * len(like)
                rep += own[like].tolist()
                common += np.cumprod(same[like].reshape(-1, TREES, DEPTH), axis=2).sum(axis=2).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rep, pa.int64()), pa.array(common, pa.list_(pa.int32()))], names=["q", "rep", "common"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in b.column(c).to_pylist()] for c in ("x", "y")]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
            use = [n >= threshold * (len(x) + len(y) - n) - 1e-9 for n, x, y in zip(both, *sets)]
            yield b.select(["common"]).filter(pa.array(use, pa.bool_()))

    found = reps.select("rep", "sig").mapInArrow(near, "q bigint, rep bigint, common array<int>")
    by = Window.partitionBy("q").orderBy(F.xxhash64("rep"), "rep")
    pairs = _util.cut(found.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= PARTNERS).drop("k"), "audit")
    ids = pairs.select("q").unionByName(pairs.select(F.col("rep").alias("q"))).distinct().withColumnRenamed("q", "rep")  # AUDITED * (PARTNERS + 1) at most
    sets = exact_sets(docs.withColumnRenamed("doc_id", "rep").join(F.broadcast(reps.select("rep", "cls").join(F.broadcast(ids), "rep")), "rep"), size)
    sets = _util.cut(sets.dropDuplicates(["rep"]), "audit-sets")
    both = pairs.join(sets.select(F.col("rep").alias("q"), F.col("shingles").alias("x")), "q").join(sets.select("rep", F.col("shingles").alias("y")), "rep")
    got = [r.common for r in both.select("common", "x", "y").mapInArrow(alike, "common array<int>").collect()]
    _util.drop(pairs, sets)
    return np.array(got, dtype=np.int32).reshape(-1, TREES)


def choose_depths(common: np.ndarray, threshold: float, target: float) -> tuple[list[int], float]:
    """(length of the prefix in each tree, recall over the audited pairs): as long as the target allows by the model and by the audit."""
    depths = [DEPTH] * TREES
    while True:
        model = 1 - math.prod(1 - threshold**d for d in depths)
        recall = float((common >= np.array(depths)).any(axis=1).mean()) if len(common) else 1.0
        if min(model, recall) >= target or max(depths) == 1:
            return depths, recall
        depths[depths.index(max(depths))] -= 1


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every two sets."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), dtype=np.float32)
    few = (df[col] > 1) & (df[col] <= 32)
    order = np.argsort(col[few], kind="stable")
    rows, width = who[few][order], df[col[few]][order]
    for d in np.unique(width):
        table = rows[width == d].reshape(-1, d)
        i, j = np.nonzero(~np.eye(d, dtype=bool))
        for k in range(0, len(table), 1 + 2_000_000 // (d * d)):
            part = table[k : k + 1 + 2_000_000 // (d * d)]
            np.add.at(out, (part[:, i].ravel(), part[:, j].ravel()), 1)
    many = df[col] > 32
    if many.any():
        names, at = np.unique(col[many], return_inverse=True)
        rows = who[many]
        for k in range(0, len(names), 1024):
            use = (at >= k) & (at < k + 1024)
            block = np.zeros((m, min(1024, len(names) - k)), dtype=np.float32)
            block[rows[use], at[use] - k] = 1
            out += block @ block.T
    return out


def verified(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(rep, links, other) of one block: linked documents (classes with their sizes) and a spanning edge to the smallest linked one."""
    made = []
    for _, part in frame.drop_duplicates(["comp", "rep"]).groupby("comp"):
        if len(part) < 2:
            continue
        reps, sizes, side = part["rep"].to_numpy(), part["size"].to_numpy(dtype=np.int64), part["side"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
        n = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets).astype(np.float64)
        link = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
        np.fill_diagonal(link, False)
        if side.min() >= 0:  # two blocks meet, of which one may be empty here: links within a block are counted in its own task
            link &= side[:, None] != side[None, :]
        if not link.any():
            continue
        label = np.arange(len(reps))[np.argsort(np.argsort(reps))]  # ranks by id
        while True:
            low = np.where(link, label[None, :], len(reps)).min(axis=1)
            new = np.minimum(label, low)
            if (new == label).all():
                break
            label = new
        by = np.sort(reps)
        has = link.any(axis=1)
        made.append(pd.DataFrame({"rep": reps[has], "links": (link @ sizes)[has], "other": by[label[has]]}))
    return pd.concat(made) if made else pd.DataFrame({"rep": [], "links": [], "other": []}).astype("int64")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, target: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    class_id is the smallest id with the same shingle set, n_links the number of other documents with a
    Jaccard similarity of ``threshold`` or more, component_id the smallest id reachable by such links, kept
    whether the document is that one. Null, empty and short texts (fewer than ``size`` words) link
    with nothing. Rows with a null id are left out; rows that repeat an id and a text count once.
    """
    spark = docs.sparkSession
    _util.tune(spark)
    docs = _util.only(docs, "doc_id", "text").filter("doc_id is not null")
    every = _util.cut(sketched(docs, size), "sketches")
    ids = every.select("doc_id", "cls").distinct()
    classes = _util.cut(ids.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    reps = _util.cut(every.join(classes.select("cls", F.col("rep").alias("doc_id"), "size"), ["cls", "doc_id"]).dropDuplicates(["cls"]).select(F.col("doc_id").alias("rep"), "cls", "n", "size", "sig"), "reps")
    depths, _ = choose_depths(audited(docs, reps, size, threshold), threshold, target)
    nodes = reps.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(t), F.slice("sig", t * DEPTH + 1, d)) for t, d in enumerate(depths)])).alias("node"))
    firsts = nodes.groupBy("node").agg(F.min("rep").alias("first"), F.count("*").alias("c")).filter("c > 1").select("node", "first")
    stars = nodes.join(firsts, "node").filter("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    comps = components(stars)
    members = _util.cut(comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")).join(reps.drop("sig"), "rep"), "members")
    blocks = _blocks(members, threshold)

    texts = docs.withColumnRenamed("doc_id", "rep").join(blocks, "rep")
    whole = exact_sets(texts, size)
    dealt = whole.select("rep", "comp", "size", "shingles", F.explode("tasks").alias("t")).select("rep", "comp", "size", "shingles", F.col("t.task").alias("task"), F.col("t.side").alias("side"))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        return verified(frame, threshold)

    found = _util.cut(dealt.groupBy("task").applyInPandas(each, "rep bigint, links bigint, other bigint"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), "component")
    about = classes.join(links, "rep", "left").join(final, "rep", "left").select("cls", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    return ids.join(about, "cls", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, comp, cls, size, tasks): the tasks that verify each member, and on which side of a pair of blocks it stands (-1: in the task of its own block).

    Small sets are packed together; of a large one, a cell holds the members of one size class, cut
    into blocks, and blocks of the same and of neighbouring size classes meet in pairs.
    """
    weight = F.col("n") + PER_DOC
    stats = members.groupBy("comp").agg(F.sum(weight).alias("w"))
    total = stats.filter(f"w <= {BLOCK}").agg(F.sum("w")).first()[0] or 0
    packs = max(1, math.ceil(total / BLOCK))
    placed = members.join(stats, "comp")
    small = placed.filter(f"w <= {BLOCK}").select("rep", "comp", "cls", "size", F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(packs)).cast("long").alias("task"), F.lit(-1).alias("side"))).alias("tasks"))
    large = placed.filter(f"w > {BLOCK}").withColumn("cell", F.floor(F.log(F.col("n") + 0.5) / math.log(1 / threshold)).cast("long"))
    cells = large.groupBy("comp", "cell").agg(F.ceil(F.sum(weight) / BLOCK).cast("long").alias("nb"))
    for side, step in (("up", 1), ("down", -1)):
        large = large.join(cells.select("comp", (F.col("cell") - step).alias("cell"), F.col("nb").alias(side)), ["comp", "cell"], "left")
    large = large.join(cells, ["comp", "cell"]).withColumn("a", F.pmod(F.xxhash64("rep"), F.col("nb")))

    def pair(low_cell, low, high_cell, high, side):
        key = F.xxhash64(F.lit("pair"), F.col("comp"), low_cell, low, high_cell, high)
        return F.struct(key.alias("task"), side.cast("int").alias("side"))

    def upto(n):
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    cell, a = F.col("cell"), F.col("a")
    tasks = F.concat(
        F.transform(upto(F.col("nb")), lambda b: pair(cell, F.least(a, b), cell, F.greatest(a, b), F.when(a == b, -1).otherwise((a > b).cast("int")))),
        F.transform(upto(F.col("up")), lambda b: pair(cell, a, cell + 1, b, F.lit(0))),
        F.transform(upto(F.col("down")), lambda b: pair(cell - 1, b, cell, a, F.lit(1))),
    )
    return small.unionByName(large.select("rep", "comp", "cls", "size", tasks.alias("tasks")))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; rows without an id stay, repeated ids stay or go together."""
    gone = near_duplicates(docs, **how).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_util.read(spark, sf_dir, "documents"))


#: The same by plain SQL over all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(h)) AS x FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, x) AS class_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
m AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(links, 0) AS n_links, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m ON m.a = d.doc_id JOIN c ON c.node = d.doc_id
"""
