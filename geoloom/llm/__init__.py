"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it (``corpus_pipeline.py`` and
``__spark_entry__.py`` at the repository top apart).
"""
