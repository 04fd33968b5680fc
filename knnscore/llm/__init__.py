"""Training-data operators: tokenising, de-duplication, filtering, extraction and archiving.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
