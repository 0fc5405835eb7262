"""Operators for large text corpora: deduplication, filtering, scoring, packing.

Nothing outside this subpackage imports it.
"""
