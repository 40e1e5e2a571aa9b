"""Training-data operators: deduplication, tokenisation, scoring, packing, screening.

Nothing outside this subpackage imports it.
"""
