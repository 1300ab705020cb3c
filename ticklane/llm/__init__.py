"""Operators for large-scale training-data pipelines (text, urls, chat, images).
Nothing outside this subpackage imports it: it can be removed with ``tests/llm`` and
``corpus_pipeline.py`` and the rest of the library keeps working.
"""
