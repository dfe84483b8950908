"""Operators for preparing training corpora: filtering, deduplication, scoring, tokenising, archiving.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
