"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame;
``run`` writes each stage's result as Parquet to the shared folder and rereads it for the next. All stages but the
last return the columns of ``documents``. Where texts change, ``n_chars`` is their new length.

Odd rows have defined results in every stage: null and empty texts stay (as documents without words), rows without an id
stay, rows that repeat an id stay or go together (by their texts in the first stage), empty tables give empty tables, and further
columns, whatever their names, are carried along up to the last stage. A document that loses all its lines in line dedup, an exact copy
of an earlier one above all, goes there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.llm import _util, bpe, decontam, line_dedup, ngram_join, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5; the model learns from the labelled rows among them."""
    model = toxicity.train(docs, _util.read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or nearly repeat an earlier one; those that had lines and lose them all go."""
    out = line_dedup.dedup_lines(docs, emptied=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontam.decontaminate(docs, _util.read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: Toxicity and byte-level BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _util.read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = _util.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            _util.drop(last)
        last = docs
    return docs
