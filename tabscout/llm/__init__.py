"""Operators for training-data pipelines: mixing, scoring, dedup, search, scans, tokens.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on it.
"""
