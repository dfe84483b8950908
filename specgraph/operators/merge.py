"""Merging an upload into a stored graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Similarities from which a match counts at once, and from which a verifier is asked.
MATCH, REVIEW = 0.90, 0.80
#: Stored vectors compared with at once.
BLOCK_ROWS = 200_000


def match_entities(new: DataFrame, old: DataFrame, verify=None) -> DataFrame:
    """(id, matched_to, method, score) for new rows (id, vector): equal id, else the most similar old row (ties: smallest id).

    method is exact_id, semantic (at least MATCH), verified (at least REVIEW, where ``verify``, a function of the
    candidate rows, keeps the row) or unmatched. Old vectors are compared with in blocks of bounded size.
    """
    exact = new.select("id").join(old.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("matched_to"), F.lit("exact_id").alias("method"), F.lit(1.0).alias("score"))
    rest = new.join(old.select("id").distinct(), "id", "left_anti").select("id", "vector")
    best = best_match(rest, old.select("id", "vector"))
    hit = best.filter(F.col("score") >= MATCH).withColumn("method", F.lit("semantic"))
    if verify is not None:
        hit = hit.unionByName(verify(best.filter((F.col("score") >= REVIEW) & (F.col("score") < MATCH))).withColumn("method", F.lit("verified")))
    found = hit.select("id", "matched_to", "method", F.round("score", 3).alias("score"))
    none = rest.select("id").join(found.select("id"), "id", "left_anti").select("id", F.lit(None).cast(dict(new.dtypes)["id"]).alias("matched_to"), F.lit("unmatched").alias("method"), F.lit(None).cast("double").alias("score"))
    return exact.unionByName(found).unionByName(none)


def best_match(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, matched_to, score): each query's most similar row by cosine, in double precision; ties go to the smallest id.

    Rows go out in blocks; a block's best per query is kept and the best of all blocks wins, so that what
    leaves a task is a row per query.
    """
    kind = dict(queries.dtypes)["id"]
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def unit(v):
        x = np.stack([np.asarray(r, dtype=np.float64) for r in v])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def each(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": q["id"][:0], "matched_to": q["id"][:0], "score": np.zeros(0)})
        r = r.sort_values("id")
        x, names = unit(r["vector"]), r["id"].to_numpy()
        at, score = [], []
        for k in range(0, len(q), 1024):
            s = unit(q["vector"].iloc[k : k + 1024]) @ x.T
            at.append(s.argmax(axis=1))
            score.append(s.max(axis=1))
        return pd.DataFrame({"id": q["id"].to_numpy(), "matched_to": names[np.concatenate(at)], "score": np.concatenate(score)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(each, f"id {kind}, matched_to {kind}, score double")
    return found.groupBy("id").agg(F.min_by(F.struct("matched_to", "score"), F.struct(-F.col("score"), "matched_to")).alias("m")).select("id", "m.matched_to", "m.score")


def _targets(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_id", "rel_type").agg(F.array_sort(F.collect_set("dst_id")).alias("existing"))


def conflicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """(src_id, rel_type, new_dst, existing): new edges whose source and type are known with other targets only."""
    j = new.select("src_id", "rel_type", F.col("dst_id").alias("new_dst")).join(_targets(old), ["src_id", "rel_type"])
    return j.filter(~F.array_contains("existing", F.col("new_dst")))


def preserve(new: DataFrame, old: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to add, edges to remove). decisions: src_id, rel_type, dst_id, decision in extend (also where none is given), replace, skip."""
    key = ["src_id", "rel_type", "dst_id"]
    fresh = new.join(old.select(*key).distinct(), key, "left_anti").join(decisions, key, "left").withColumn("decision", F.coalesce("decision", F.lit("extend")))
    add = fresh.filter("decision != 'skip'").select("src_id", "dst_id", "rel_type")
    replaced = fresh.filter("decision = 'replace'").select("src_id", "rel_type").distinct()
    remove = old.join(replaced, ["src_id", "rel_type"], "left_semi").select("src_id", "dst_id", "rel_type").distinct()
    return add, remove


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends renamed by (id, matched_to), once each."""
    m = mapping.select("id", "matched_to")
    e = edges.join(m.select(F.col("id").alias("src_id"), F.col("matched_to").alias("_s")), "src_id", "left").join(m.select(F.col("id").alias("dst_id"), F.col("matched_to").alias("_d")), "dst_id", "left")
    return e.select(F.coalesce("_s", "src_id").alias("src_id"), F.coalesce("_d", "dst_id").alias("dst_id"), "rel_type").distinct()


def checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n) of a merged graph: edges with a missing end, repeated triples, nodes without edges."""
    ids = nodes.select("node_id").distinct()
    key = ["src_id", "dst_id", "rel_type"]
    sound = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").groupBy(*key).count()
    repeated = sound.agg(F.lit("duplicate_edges").alias("problem"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("sound"))
    dangling = edges.agg(F.count("*").alias("all")).crossJoin(repeated).select(F.lit("dangling_edges").alias("problem"), (F.col("all") - F.col("sound")).alias("n"))  # one row each
    ends = edges.select(F.col("src_id").alias("node_id")).unionByName(edges.select(F.col("dst_id").alias("node_id"))).distinct()
    return repeated.drop("sound").unionByName(dangling).unionByName(ids.join(ends, "node_id", "left_anti").agg(F.lit("isolated_nodes").alias("problem"), F.count("*").alias("n")))
