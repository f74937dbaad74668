"""Training-data operators: tokenising, scoring, extraction, filtering, deduplication, packing.

Nothing outside this subpackage imports it.
"""
