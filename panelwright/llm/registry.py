"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from panelwright.llm import bpe_codec, cover_tree, exact_dedup, lm_scoring, packing, pii, sharding, simhash, token_counts, toxicity

MODULES = [cover_tree, token_counts, lm_scoring, sharding, bpe_codec, toxicity, exact_dedup, packing, pii, simhash]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
