"""Operators for large training corpora, their queries and SQL.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
