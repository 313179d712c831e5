"""Operators for building training corpora at scale.

Nothing outside this package imports it.  Each module holds one operator;
``queries`` registers them over the synthetic tables, and the repository's
``corpus_pipeline`` chains five of them.
"""
