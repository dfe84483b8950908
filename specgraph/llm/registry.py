"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, hnsw, line_dedup, lm, ngram_join, quality, records, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontam.query,
    "op2_quality_ranker": quality.query,
    "op3_hnsw_dedup": hnsw.query,
    "op4_toxicity": toxicity.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_deleted_interpolation": lm.query,
    "op7_line_dedup": line_dedup.query,
    "op8_token_records": records.query,
    "op9_byte_bpe": bpe.query,
    "op10_warc": warc.query,
}

SQL: dict[str, str] = {"op1_decontaminate": decontam.SQL, "op3_hnsw_dedup": hnsw.SQL, "op5_ngram_jaccard_join": ngram_join.SQL, "op7_line_dedup": line_dedup.SQL, "op10_warc": warc.SQL}
