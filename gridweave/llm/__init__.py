"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Queries
are registered in :mod:`gridweave.llm.registry`.
"""
