"""Training-data operators: deduplication, tokenisation, scoring, packing, sharding, PII.

Nothing else in the library imports this subpackage.
"""
