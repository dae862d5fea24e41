"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontamination, fingerprints, html_main, language_model, merkle, near_dedup, packing, prefix_trie, quality, substring, token_output, toxicity

MODULES = [token_output, language_model, decontamination, fingerprints, quality, toxicity, packing, html_main, near_dedup, substring, merkle, bpe, prefix_trie]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in getattr(m, "ORACLES", {}).items()}
