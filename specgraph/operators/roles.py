"""Semantic roles of nodes and edges, and the universe that tests are to cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions.text import first_match, member_role

#: Roles that a test can exercise.
TESTABLE = ("workflow_step", "workflow_state", "business_rule", "input")


def is_artifact():
    """Test cases and document metadata, by type or by the id's prefix."""
    low = F.lower("node_id")
    return F.lower(F.coalesce("node_type", F.lit(""))).isin(*O.FLOW_EXCLUDED_TYPES) | low.startswith("testcase::") | low.startswith("tc::")


def classify_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with role, testable, confidence and decided_by: by artefact, type, words in the name, else other."""
    by_type = member_role(F.coalesce("node_type", F.lit("")), O.NODE_ROLES)
    low = F.lower(F.coalesce("name", F.lit("")))
    by_name = first_match([(low.rlike("|".join(words)), F.lit(role)) for role, words in O.NAME_ROLES], F.lit(None).cast("string"))
    step = first_match([(is_artifact(), F.lit("artifact")), (by_type.isNotNull(), F.lit("type")), (by_name.isNotNull(), F.lit("name"))], F.lit("fallback"))
    n = nodes.withColumn("decided_by", step)
    role = F.when(F.col("decided_by") == "artifact", "artifact").when(F.col("decided_by") == "type", by_type).when(F.col("decided_by") == "name", by_name).otherwise("other")
    n = n.withColumn("role", role).withColumn("testable", F.col("role").isin(*TESTABLE))
    return n.withColumn("confidence", F.when(F.col("decided_by") == "artifact", 1.0).when(F.col("decided_by") == "type", 0.95).when(F.col("decided_by") == "name", 0.8).otherwise(0.3))


def classify_edges(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges with role: metadata beside an artefact, by type, a transition beside metadata is an attribute, unknown types by the roles of their ends."""
    r = roles.select("node_id", "role")
    e = edges.join(r.select(F.col("node_id").alias("src_id"), F.col("role").alias("_a")), "src_id", "left").join(r.select(F.col("node_id").alias("dst_id"), F.col("role").alias("_b")), "dst_id", "left")
    a, b = F.coalesce("_a", F.lit("other")), F.coalesce("_b", F.lit("other"))
    by_type = member_role(F.col("rel_type"), O.EDGE_ROLES)
    steps = ("workflow_step", "workflow_state")
    inferred = first_match([
        (a.isin("actor", *steps) & b.isin(*steps), F.lit("workflow_transition")), (b.isin("input", "metadata"), F.lit("attribute")),
        (b == "business_rule", F.lit("business_rule")), (b == "requirement", F.lit("semantic_relation")),
    ], F.lit("other"))
    role = first_match([
        ((a == "artifact") | (b == "artifact"), F.lit("metadata")),
        ((by_type == "workflow_transition") & ((a == "metadata") | (b == "metadata")), F.lit("attribute")),
        (by_type.isNotNull(), by_type),
    ], inferred)
    return e.withColumn("role", role).drop("_a", "_b")


def universe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(list, id): what a test suite is measured against; artefacts and metadata are in none of the lists."""
    n = nodes.filter(~F.col("role").isin("artifact", "metadata"))
    names = {"workflow": ("workflow_step", "workflow_state"), "actors": ("actor",), "inputs": ("input",), "business_rules": ("business_rule",), "requirements": ("requirement",)}
    out = None
    for name, roles in names.items():
        part = n.filter(F.col("role").isin(*roles)).select(F.lit(name).alias("list"), F.col("node_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    key = F.concat_ws("|", "src_id", "rel_type", "dst_id")
    for name, role in (("transitions", F.col("role") == "workflow_transition"), ("edges", F.col("role") != "metadata")):
        out = out.unionByName(edges.filter(role).select(F.lit(name).alias("list"), key.alias("id")))
    return out
