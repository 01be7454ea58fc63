"""All queries of the engine's operators and their SQL, by name."""

from __future__ import annotations

from quernstone.plans import conversation_queries, record_queries, source_queries, structure_queries, text_queries

_PARTS = (text_queries, conversation_queries, structure_queries, record_queries, source_queries)
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
