"""Scans and upserts of stored graphs, versions, evaluation runs and prompts, as Parquet tables.

A table's generation is a folder of its own; an upsert builds the next one from the last and what is new. ``save``
writes a generation and moves the pointer last, so that readers see whole generations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; new rows win, the last of ``new`` by ord; a null in ``keep_old`` columns keeps what was there."""
    w = W.partitionBy(*keys)
    every = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    r = every.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_gen"), F.desc("ord"))))
    for c in keep_old:
        r = r.withColumn(c, F.coalesce(c, F.last(c, ignorenulls=True).over(w.orderBy("_gen", "ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    return r.filter("_rn = 1").drop("_rn", "_gen")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by triple; new ones with a missing end are left out."""
    ids = nodes.select("node_id").distinct()
    sound = new.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return upsert(old, sound, ["src_id", "dst_id", "rel_type"], ("source",))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src_id", "dst_id", "rel_type").distinct(), ["src_id", "dst_id", "rel_type"], "left_anti").select(*edges.columns)


def save(df: DataFrame, folder: str) -> str:
    """Write the next generation of a table; returns its path."""
    path = f"{folder}/gen-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/_pointer")
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest generation of a table."""
    path = spark.read.parquet(f"{folder}/_pointer").agg(F.max_by("path", F.struct("written_at", "path"))).first()[0]
    return spark.read.parquet(path)


def document_graph(nodes: DataFrame, edges: DataFrame, doc: str | None) -> tuple[DataFrame, DataFrame]:
    """The part of a graph whose doc_id or source is ``doc``; nothing, "All", "All Documents", or a name that begins like the stored whole, gives all."""
    if not doc or doc.startswith("Stored Requirement Graph") or doc in ("All", "All Documents"):
        return nodes.dropDuplicates(["node_id"]), edges.dropDuplicates(["src_id", "dst_id", "rel_type"])
    n = nodes.filter((F.col("doc_id") == doc) | (F.col("source") == doc)).dropDuplicates(["node_id"])
    ids = n.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return n, e.dropDuplicates(["src_id", "dst_id", "rel_type"])


def documents(nodes: DataFrame) -> DataFrame:
    """(name) of stored documents: doc_ids, else sources with generated ids as one range."""
    ids = nodes.filter("doc_id is not null and doc_id != ''").select(F.col("doc_id").alias("name")).distinct()
    src = nodes.filter("source is not null and source != ''").select("source").distinct()
    gen = src.filter("source like 'GEN-%'").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a is not null").select(F.concat_ws(" to ", "a", "b").alias("name"))
    other = src.filter("source not like 'GEN-%'").select(F.col("source").alias("name")).unionByName(gen)
    has = ids.limit(1).withColumn("has", F.lit(True))
    return ids.unionByName(other.join(F.broadcast(has.select("has")), F.lit(True), "left_anti"))  # one row at most


def community_nodes(nodes: DataFrame, edges: DataFrame, community: Column) -> tuple[DataFrame, DataFrame]:
    n = nodes.filter(F.col("community") == community)
    ids = n.select("node_id")
    return n, edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").select(*edges.columns)


def version_chain(versions: DataFrame, *by: str) -> DataFrame:
    """Versions, oldest first, each with the one before it (of the same ``by``, where a table holds those of several graphs)."""
    return versions.withColumn("previous_id", F.lag("version_id").over(W.partitionBy(*by).orderBy("created_at", "version_id")))  # a row a version


def snapshot(nodes: DataFrame, edges: DataFrame, folder: str, version_id: str, label: str) -> None:
    """Keep a graph as a version: partitions of the snapshot tables and a row about it, written last."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("version_id", F.lit(version_id)).write.mode("append").partitionBy("version_id").parquet(f"{folder}/{name}_v")
    about = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    about.select(F.lit(version_id).alias("version_id"), F.lit(label).alias("label"), F.current_timestamp().alias("created_at"), "node_count", "edge_count").write.mode("append").parquet(f"{folder}/versions")


def append_evaluation(report: DataFrame, folder: str) -> None:
    """Append evaluation runs with their details as JSON."""
    report.withColumn("details", F.to_json(F.struct(*report.columns))).withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(folder)


def save_prompt(prompts: DataFrame, name: str, label: str, template: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Prompts (name, label, version, template) with one version more; the template must hold every placeholder."""
    missing = [p for p in required if "{" + p + "}" not in template]
    if missing:
        raise ValueError(f"placeholders are missing: {missing}")
    nxt = prompts.filter(F.col("name") == name).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return prompts.unionByName(nxt.select(F.lit(name).alias("name"), F.lit(label).alias("label"), "version", F.lit(template).alias("template")))


def current_prompts(prompts: DataFrame, seeds: DataFrame) -> DataFrame:
    """The newest version of every prompt; seeds where none is stored."""
    every = prompts.unionByName(seeds.join(prompts.select("name").distinct(), "name", "left_anti").select(*prompts.columns))
    return every.groupBy("name").agg(F.max_by(F.struct("label", "version", "template"), "version").alias("p")).select("name", "p.label", "p.version", "p.template")


def delete_prompt(prompts: DataFrame, name: str) -> DataFrame:
    """Prompts without any version of one."""
    return prompts.filter(F.col("name") != name)


def inserted(nodes: DataFrame, new: DataFrame, batch: str | None = None) -> DataFrame:
    """Nodes with new ones in place of those of the same id; the new ones carry batch_id where one is given."""
    keep = nodes if "batch_id" in nodes.columns else nodes.withColumn("batch_id", F.lit(None).cast("string"))
    add = new.dropDuplicates(["node_id"]).withColumn("batch_id", F.lit(batch).cast("string"))
    return keep.join(add.select("node_id"), "node_id", "left_anti").unionByName(add, allowMissingColumns=True)


def cleared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table without rows, one row: how many there were)."""
    return rows.limit(0), rows.agg(F.count("*").alias("deleted"))


def with_communities(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """Nodes with the community that ``partition`` (node_id, community) has for them."""
    return nodes.drop("community").join(partition.select("node_id", "community"), "node_id", "left")


def community_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("community is not null").groupBy("community").agg(F.count("*").alias("size"))


def typed_nodes(rows: DataFrame) -> DataFrame:
    """Stored nodes with attributes_json as a map (null where it isn't an object)."""
    return rows.withColumn("attributes", F.from_json("attributes_json", "map<string,string>")).drop("attributes_json")


def tokens(nodes: DataFrame) -> DataFrame:
    """(token, node_id, kind): ids and names in lower case that stand for nodes of several generations (column gen).

    An id's token means the node of the last generation; a name's that of the first, by id among equals, and only where no id has it.
    """
    clean = lambda c: F.lower(F.trim(c))
    ids = nodes.filter("node_id is not null").groupBy(clean("node_id").alias("token")).agg(F.max_by("node_id", F.struct("gen", "node_id")).alias("node_id")).withColumn("kind", F.lit("id"))
    names = nodes.filter("name is not null").groupBy(clean("name").alias("token")).agg(F.min_by("node_id", F.struct("gen", "node_id")).alias("node_id")).withColumn("kind", F.lit("name"))
    return ids.unionByName(names.join(ids.select("token"), "token", "left_anti"))
