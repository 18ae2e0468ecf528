"""Operators for large text corpora: tokenizing, packing, filtering, deduplication.

Nothing outside this package imports it; `queries.py` lists its queries.
"""
