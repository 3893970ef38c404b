"""Operators for preparing training data: mixing, deduplication, extraction, scans, packing and output.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it; ``__spark_entry__.py`` adds its queries when the folder exists.
"""
