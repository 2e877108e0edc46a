"""The queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from tautline.llm import align, bpe, decontaminate, html, lines, pii, quality, search, secrets, sharding, simhash, substring, tokens

MODULES = (secrets, html, decontaminate, simhash, substring, pii, lines, quality, bpe, sharding, align, search, tokens)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: x for m in MODULES for k, x in getattr(m, "ORACLE_SQL", {}).items()}
