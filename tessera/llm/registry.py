"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from tessera.llm import fingerprints, language_id, license_scan, near_duplicates, packing, sentencepiece_bpe, token_counts, toxicity, vector_topk, warc_fixity

MODULES = [toxicity, near_duplicates, sentencepiece_bpe, token_counts, vector_topk, warc_fixity, language_id, license_scan, fingerprints, packing]

QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= getattr(_m, "ORACLE", {})
