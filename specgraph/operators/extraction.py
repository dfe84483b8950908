"""Rules around entity extraction: which texts are metadata or procedures, where results come from, which edges sequences leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Words of a document control table, of which two tell one.
METADATA_WORDS = ("version", "revision", "document control", "change description", "author", "reviewed by", "approved by", "document history", "version history", "page number")

# A text that is a page header or footer, and patterns of such artefacts within a text.
PAGE_LINE = r"^(?:forvis\s+mazars\s+\d+|page\s+\d+(?:\s+of\s+\d+)?|document\s+control|version\s+history)$"
PAGE_ARTIFACT = r"(?:page\s+\d+\s+of\s+\d+|version\s+\d+\.\d+.*author|change\s+description.*version)"

# Signs of a procedure.
PROCEDURE_SIGNS = (
    r"(?:^|\n)\s*\d+[\.\)]\s+\w",
    r"(?:^|\n)\s*[-*•]\s+\w",
    r"\b(?:then|next|after\s+that|following(?:ly)?|subsequently|finally|first(?:ly)?|second(?:ly)?|third(?:ly)?|step\s+\d|proceed\s+to|upon\s+success)\b",
    r"\b(?:the\s+(?:user|system|admin|customer|actor)\s+(?:shall|must|will|should|can|clicks?|enters?|submits?|selects?|navigates?|uploads?|triggers?))\b",
    r"(?:→|->|==>)",
    r"\bAC[-_]?\d+\b",
    r"\b(?:given|when|then)\b",
    r"(?:^|\n)\s*(?:Step|Phase|Stage)\s+\d+",
)

# Signs of a text that is none.
OTHER_SIGNS = (
    r"\b(?:definition|glossary|abbreviation|terminology|legend)\b",
    r"\b(?:non[-\s]?functional|NFR|performance\s+requirement|scalability|availability|reliability)\b",
    r"(?:^|\n)\s*(?:Table\s+of\s+Contents|Revision\s+History|Document\s+Control|Appendix\s+[A-Z]|References?|Bibliography)\b",
)


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for any of several, whatever the case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def metadata_reason(text: Column) -> Column:
    """Why a text is document metadata: document_control_table, page_header_footer or page_artifact; null for other texts."""
    low = _stripped(F.lower(text))
    words = reduce(Column.__add__, [F.contains(low, F.lit(w)).cast("int") for w in METADATA_WORDS])
    return F.when(words >= 2, "document_control_table").when(low.rlike(PAGE_LINE), "page_header_footer").when(low.rlike(PAGE_ARTIFACT), "page_artifact")


def is_procedural(text: Column) -> Column:
    """Whether a text of 40 characters or more shows a sign of a procedure and none of another kind of text."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(_stripped(text)) >= 40) & ~whole.rlike(any_of(OTHER_SIGNS)) & whole.rlike(any_of(PROCEDURE_SIGNS))


def tagged(rows: DataFrame, item: Column, doc: Column | None = None) -> DataFrame:
    """Extracted rows with ``item`` as their source, whatever it was, and ``doc`` as doc_id where it is given and not null."""
    out = rows.withColumn("source", item)
    if doc is None:
        return out
    return out.withColumn("doc_id", F.coalesce(doc, F.col("doc_id")) if "doc_id" in rows.columns else doc)


def together(parts: list[DataFrame]) -> DataFrame:
    """All rows of several extractions; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without_actor_shortcuts(edges: DataFrame, actors: DataFrame, steps: DataFrame, flows: DataFrame) -> DataFrame:
    """Edges less those of actors into the middle of a flow.

    ``steps`` (node_id) are the ends of the sequences found, ``flows`` (actor_id, entry_id) say where each begins; of an actor's several flows the
    last entry by id counts. An actor keeps the edge to its own entry, or, owning none, those to any entry; edges elsewhere stay.
    """
    own = flows.filter("actor_id is not null and entry_id is not null").groupBy(F.col("actor_id").alias("src_id")).agg(F.max("entry_id").alias("_own"))
    first = flows.filter("entry_id is not null").select(F.col("entry_id").alias("dst_id"), F.lit(True).alias("_entry")).distinct()
    mark = lambda df, key, name: df.select(F.col("node_id").alias(key), F.lit(True).alias(name)).distinct()
    j = edges.join(mark(actors, "src_id", "_actor"), "src_id", "left").join(mark(steps, "dst_id", "_step"), "dst_id", "left").join(own, "src_id", "left").join(first, "dst_id", "left")
    inside = F.col("_actor").isNotNull() & F.col("_step").isNotNull()
    good = F.when(F.col("_own").isNotNull(), F.col("dst_id") == F.col("_own")).otherwise(F.col("_entry").isNotNull())
    return j.filter(~inside | good).select(*edges.columns)


def batches(paragraphs: DataFrame, most_rows: int = 10, most_chars: int = 2000) -> DataFrame:
    """Paragraphs (doc_id, pos, content) with batch, from 1 in each document: filled in order until a row more would be one too many or exceed ``most_chars``.

    A row that is longer by itself makes a batch of its own. Filling is a fold over one document's rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", (F.length("content") + 5).alias("size"))))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).alias("chars"), F.array().cast("array<struct<pos:bigint,batch:int>>").alias("out"))

    def add(s: Column, r: Column) -> Column:
        size = (r["size"] + (s["rows"] >= 9).cast("int")).cast("int")  # entries are numbered within their batch: "[10] " is a character longer
        full = (s["batch"] == 0) | (s["rows"] >= most_rows) | (s["chars"] + size > most_chars)
        batch = (s["batch"] + full.cast("int")).cast("int")
        return F.struct(
            batch.alias("batch"), F.when(full, 1).otherwise(s["rows"] + 1).cast("int").alias("rows"), F.when(full, r["size"]).otherwise(s["chars"] + size).cast("int").alias("chars"),
            F.concat(s["out"], F.array(F.struct(r["pos"].cast("bigint").alias("pos"), batch.alias("batch")))).alias("out"),
        )

    folded = paragraphs.groupBy("doc_id").agg(F.aggregate(rows, start, add, lambda s: s["out"]).alias("x"))
    return folded.select("doc_id", F.inline("x"))


def generated_ids(items: DataFrame, order: str = "pos") -> DataFrame:
    """Items with item_id GEN-001, GEN-002, … in the order of ``order`` within each document."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(order))
    return items.withColumn("item_id", F.concat(F.lit("GEN-"), F.lpad(n.cast("string"), 3, "0")))
