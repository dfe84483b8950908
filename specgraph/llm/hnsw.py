"""Near-duplicate vectors by navigable small-world graphs: one hierarchy per shard, every shard searched by every vector.

Vectors are dealt to shards of bounded size and each shard gets a hierarchical graph. Searches run for many
queries at once. A query's beam is widened until it reaches below the threshold (so that a group larger
than the beam is found whole). The first beam is fixed beforehand, by an audit of sampled queries against brute force
over all shards; if no beam passes it, all pairs are compared. Pairs found are verified in double precision, counted, and reduced to spanning edges
within the task, so that a large group never leaves it as pairs. Equal vectors are searched for once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util
from .components import components

#: Rows of a shard, at most about; shards, at least; queries of one task.
SHARD_ROWS, LEAST_SHARDS, TASK_ROWS = 16_384, 4, 16_384
#: Links per node (twice as many at the bottom), beam while building, first beam of a search, nodes expanded at once.
LINKS, BUILD_BEAM, FIRST_BEAM, AT_ONCE = 16, 48, 16, 4
#: Queries audited at first and at most (or all there are), how many must have pairs, the mean recall they must reach, and the beams tried.
AUDITED, MOST_AUDITED, LEAST_AUDITED, RECALL = 256, 16_384, 100, 0.99
BEAMS = (FIRST_BEAM, 32, 64, 128, 256, 512)
#: Queries searched at once, and cells of the table of visited nodes.
TOGETHER, VISITED = 512, 16_000_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by their lengths."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _diverse(sims: np.ndarray, between: np.ndarray, ok: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (columns, by falling similarity) to link: those nearer to the node than to any candidate linked before; then the nearest others."""
    rows, n = sims.shape
    take = np.zeros((rows, n), dtype=bool)
    nearest = np.full((rows, n), -2.0, dtype=np.float32)  # similarity to the closest candidate taken so far
    for c in range(n):
        good = ok[:, c] & (nearest[:, c] < sims[:, c]) & (take.sum(axis=1) < most)
        take[:, c] = good
        nearest = np.where(good[:, None], np.maximum(nearest, between[:, c]), nearest)
    rest = ok & ~take
    free = most - take.sum(axis=1, keepdims=True)
    return take | (rest & (np.cumsum(rest, axis=1) <= free))


class Graph:
    """A hierarchy over the rows of ``x`` (unit length); ``links`` holds a table of neighbours per level, -1 where there is none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray | None = None, links: list[np.ndarray] | None = None):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        if levels is None:
            u = np.random.default_rng(5).random(n)
            levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(np.int64), 6)
        self.levels = levels
        self.entry = int(np.argmax(levels)) if n else -1
        if links is not None:
            self.links = links
            return
        self.links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(int(levels.max()) + 1 if n else 1)]
        order = np.argsort(-levels, kind="stable")
        done = 1
        while done < n:
            size = min(done, TOGETHER, n - done)
            self._insert(order[done : done + size])
            done += size

    def _insert(self, new: np.ndarray) -> None:
        for level in range(int(self.levels[new].max()), -1, -1):
            rows = new[self.levels[new] >= level]
            q = self.x[rows]
            ids, sims = self._beam(q, self._down(q, level), level, BUILD_BEAM)
            # The batch's own rows are not in the graph yet; they can be neighbours too.
            own = q @ q.T
            np.fill_diagonal(own, -2)
            k = min(LINKS, len(rows))
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.hstack((ids, rows[near].astype(np.int32)))
            sims = np.hstack((sims, np.take_along_axis(own, near, axis=1)))
            ids[ids == rows[:, None]] = -1
            table = self.links[level]
            chosen = self._choose(rows, ids, sims, table.shape[1] // (2 if level == 0 else 1))
            table[rows, : chosen.shape[1]] = chosen
            self._back(rows, chosen, level)

    def _choose(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates, -1 after them."""
        sims = np.where(ids < 0, -2, sims).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(rows), most), -1, dtype=np.int32)
        for k in range(0, len(rows), 256):
            i, s = ids[k : k + 256], sims[k : k + 256]
            ok = i >= 0
            c = self.x[np.maximum(i, 0)]
            take = _diverse(s, c @ c.transpose(0, 2, 1), ok, most)
            place = np.cumsum(take, axis=1) - 1
            r, col = np.nonzero(take)
            out[k + r, place[r, col]] = i[r, col]
        return out

    def _back(self, rows: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Add the reverse links; full tables are chosen anew."""
        table = self.links[level]
        src, dst = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0].astype(np.int32), dst[dst >= 0]
        sims = np.einsum("ij,ij->i", self.x[src], self.x[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        use = place < 2 * LINKS
        extra = np.full((len(nodes), 2 * LINKS), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(nodes)), count)[use], place[use]] = src[use]
        ids = np.hstack((table[nodes], extra))
        for k in range(0, len(nodes), 256):
            i = np.sort(ids[k : k + 256], axis=1)
            i[:, 1:][i[:, 1:] == i[:, :-1]] = -1
            s = np.einsum("id,ijd->ij", self.x[nodes[k : k + 256]], self.x[np.maximum(i, 0)])
            table[nodes[k : k + 256]] = self._choose(nodes[k : k + 256], i, s, table.shape[1])

    def _down(self, q: np.ndarray, to: int) -> np.ndarray:
        """Entry points of level ``to``: the best node found level by level from the top."""
        at = np.full((len(q), 1), self.entry, dtype=np.int32)
        for level in range(len(self.links) - 1, to, -1):
            at = self._beam(q, at, level, 2)[0][:, :1]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) [query, beam] by falling similarity: the best nodes that a beam of this width reaches."""
        n, m = len(self.x), len(q)
        seen = np.zeros(m * n, dtype=bool)
        ids = np.full((m, beam), -1, dtype=np.int32)
        sims = np.full((m, beam), -2, dtype=np.float32)
        ids[:, :1] = start[:, :1]
        sims[:, 0] = np.einsum("ij,ij->i", q, self.x[start[:, 0]])
        seen[np.arange(m) * n + start[:, 0]] = True
        todo = ids >= 0
        live = np.arange(m)
        while len(live):
            rank = np.cumsum(todo[live], axis=1)
            pick = todo[live] & (rank <= AT_ONCE)
            r, c = np.nonzero(pick)
            who = live[r]
            todo[who, c] = False
            near = self.links[level][ids[who, c]]
            keep = near >= 0
            key = (who[:, None] * n + near)[keep]
            key = np.unique(key[~seen[key]])
            if len(key):
                seen[key] = True
                row, node = key // n, key % n
                s = np.einsum("ij,ij->i", q[row], self.x[node])
                better = s > sims[row, -1]
                row, node, s = row[better], node[better], s[better]
                if len(row):
                    rows, first, count = np.unique(row, return_index=True, return_counts=True)
                    place = np.arange(len(row)) - np.repeat(first, count)
                    k = np.repeat(np.arange(len(rows)), count)
                    width = int(count.max())
                    more, value = np.full((len(rows), width), -1, dtype=np.int32), np.full((len(rows), width), -2, dtype=np.float32)
                    more[k, place], value[k, place] = node, s
                    all_ids, all_sims = np.hstack((ids[rows], more)), np.hstack((sims[rows], value))
                    all_todo = np.hstack((todo[rows], more >= 0))
                    order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                    ids[rows], sims[rows], todo[rows] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_sims, all_todo))
            live = live[todo[live].any(axis=1)]
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with a similarity of ``least`` or more; beams that end above it are widened."""
        found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        work = [(np.arange(len(q)), min(beam, len(self.x)))]
        while work:
            rows, width = work.pop()
            step = max(1, min(TOGETHER, VISITED // len(self.x), 4_000_000 // width))
            wide = []
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, sims = self._beam(q[part], self._down(q[part], 0), 0, width)
                hit = (ids >= 0) & (sims >= least)
                full = hit.all(axis=1) & (width < len(self.x))
                wide.append(part[full])
                hit[full] = False
                r, c = np.nonzero(hit)
                found_q.append(part[r])
                found_x.append(ids[r, c].astype(np.int64))
            again = np.concatenate(wide)
            if len(again):
                work.append((again, min(2 * width, len(self.x))))
        return np.concatenate(found_q), np.concatenate(found_x)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph as one row of arrays."""
    frame = frame.sort_values("rep")
    raw = np.stack(frame["embedding"].to_list()).astype(np.float32)
    g = Graph(unit(raw))
    return pd.DataFrame([(key[0], key[1], frame["rep"].to_numpy().tobytes(), frame["size"].to_numpy().tobytes(), raw.tobytes(), g.levels.tobytes(), [t.tobytes() for t in g.links])], columns=["dim", "shard", "ids", "sizes", "raw", "levels", "links"])


def _opened(shard: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """A shard's ids, class sizes, unit vectors and graph."""
    row = next(shard.itertuples())
    ids, sizes = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.sizes, dtype=np.int64)
    x = unit(np.frombuffer(row.raw, dtype=np.float32).reshape(len(ids), -1))
    return ids, sizes, x, Graph(x, np.frombuffer(row.levels, dtype=np.int64), [np.frombuffer(t, dtype=np.int32).reshape(len(ids), -1) for t in row.links])


def audited(frame: pd.DataFrame, shard: pd.DataFrame, least: float) -> pd.DataFrame:
    """(rep, beam, true, found, narrow, narrow_found): each query's pairs in the shard, and those that a beam finds; narrow where ``within`` does not widen the beam."""
    names = ["rep", "beam", "true", "found", "narrow", "narrow_found"]
    made = [np.zeros((0, 6), np.int64)]
    if len(frame) and len(shard):
        ids, _, _, g = _opened(shard)
        own = frame["rep"].to_numpy()
        q32 = unit(np.stack(frame["embedding"].to_list()).astype(np.float32)).astype(np.float32)
        for k in range(0, len(own), TOGETHER):
            q, me = q32[k : k + TOGETHER], own[k : k + TOGETHER]
            sims = q @ g.x.T
            near = (sims >= least) & (me[:, None] != ids[None, :])
            hits, true = (sims >= least - 1e-5).sum(axis=1), near.sum(axis=1)
            use = np.flatnonzero(true)
            found = np.zeros(len(me), np.int64)
            for beam in BEAMS:
                todo = use[found[use] < true[use]]  # what a beam finds whole, a wider one does
                if len(todo):
                    a, b = g.within(q[todo], least - 1e-5, beam)
                    found[todo] = np.bincount(a[near[todo[a], b]], minlength=len(todo))
                narrow = hits[use] < beam
                made.append(np.stack((me[use], np.full(len(use), beam), true[use], found[use], true[use] * narrow, found[use] * narrow), axis=1))
    return pd.DataFrame(np.concatenate(made), columns=names).astype("int64")


def first_beam(classes: DataFrame, index: DataFrame, n: int, shards: int, least: float) -> tuple[int | None, float | None, int]:
    """(beam, recall, queries): the first beam whose recall suffices, None where no beam's does; its recall and the queries with pairs that it comes from.

    Recall is averaged over queries, each with its pairs in all shards, and must suffice for all pairs and again for those
    without the groups that widen a beam anyway. An audit in which too few queries have such pairs is repeated with more queries, and does not
    pass unless all vectors are audited.
    """

    def each(q: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        return audited(q, shard, least)

    k = AUDITED
    while True:
        sample = classes.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(n)) < k) if k < n else classes
        sample = sample.select("dim", "rep", "embedding", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        keys, sums = ["dim", "shard"], ["true", "found", "narrow", "narrow_found"]
        rows = sample.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(each, "rep long, beam long, true long, found long, narrow long, narrow_found long")
        rows = rows.groupBy("rep", "beam").agg(*[F.sum(c).alias(c) for c in sums])
        rate = F.avg(F.col("found") / F.col("true")), F.avg(F.when(F.col("narrow") > 0, F.col("narrow_found") / F.col("narrow")))
        got = {r.beam: r for r in rows.groupBy("beam").agg(rate[0].alias("every"), rate[1].alias("small"), F.count("*").alias("m"), F.count(F.when(F.col("narrow") > 0, 1)).alias("few")).collect()}
        if not got and k >= n:
            return FIRST_BEAM, None, 0  # there are no pairs
        for beam in BEAMS:
            r = got.get(beam)
            if r and (k >= n or r.few >= LEAST_AUDITED) and min(r.every, 1.0 if r.small is None else r.small) >= RECALL:
                return beam, min(r.every, 1.0 if r.small is None else r.small), r.m
        enough = any(r.few >= LEAST_AUDITED for r in got.values())
        if enough or k >= min(n, MOST_AUDITED):
            return None, None, max((r.m for r in got.values()), default=0)
        k *= 8


def search(frame: pd.DataFrame, shard: pd.DataFrame, least: float, beam: int | None) -> pd.DataFrame:
    """(node, links, other): counts of the queries' verified links into the shard, and spanning edges of all links; without a beam all pairs are compared."""
    empty = pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
    if not len(frame) or not len(shard):
        return empty
    ids, sizes, x, g = _opened(shard)
    own = frame["rep"].to_numpy()
    q = unit(np.stack(frame["embedding"].to_list()).astype(np.float32))
    q32, slack = q.astype(np.float32), least - 1e-5  # single precision finds, double precision decides
    counts, edges = np.zeros(len(own), dtype=np.int64), []
    step = 4 * TOGETHER if beam else TOGETHER
    for k in range(0, len(q), step):
        a, b = g.within(q32[k : k + step], slack, beam) if beam else np.nonzero(q32[k : k + step] @ g.x.T >= slack)
        a = a + k
        other = own[a] != ids[b]
        a, b = a[other], b[other]
        sure = np.zeros(len(a), dtype=bool)
        for j in range(0, len(a), 100_000):
            sure[j : j + 100_000] = np.einsum("ij,ij->i", q[a[j : j + 100_000]], x[b[j : j + 100_000]]) >= least
        a, b = a[sure], b[sure]
        np.add.at(counts, a, sizes[b])
        if len(a):
            edges.append(stars(own[a], ids[b]))
    if not edges:
        return empty
    node, other = stars(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
    has = np.flatnonzero(counts)
    return pd.DataFrame({"node": np.concatenate((node, own[has])), "links": np.concatenate((np.zeros(len(node), np.int64), counts[has])), "other": np.concatenate((other, own[has]))})


def near_duplicates(vectors: DataFrame, least: float = 0.95, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do vectors of
    different length with each other. Rows with a null id are left out; rows that repeat an id and a vector count once.
    """
    spark = vectors.sparkSession
    _util.tune(spark)
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<float>").alias("embedding")).filter("vec_id is not null").distinct()
    rows = rows.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.transform(v, lambda c: c + F.lit(0.0).cast("float"))))  # -0.0 becomes 0.0
    good = rows.filter("embedding is not null")
    classes = _util.cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).withColumn("dim", F.size("embedding")), "vectors")
    n = classes.count()
    shards, groups = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n / TASK_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    index = _util.cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, sizes binary, raw binary, levels binary, links array<binary>"), "graphs")
    beam = first_beam(classes, index, n, shards, least)[0]
    left = classes.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def each(q: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        return search(q, shard, least, beam)

    keys = ["dim", "shard", "part"]
    found = _util.cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(each, "node bigint, links bigint, other bigint"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    about = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("embedding", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(about, "embedding", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_util.read(spark, sf_dir, "embeddings"))


#: The same by plain SQL over all pairs.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id JOIN c ON node = vec_id
"""
