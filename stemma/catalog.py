"""All registered queries of the index library, and their SQL for DuckDB."""

from __future__ import annotations

from stemma.plans import code_queries, edit_queries, outline_queries, payload_queries, reference_queries, search_queries

_MODULES = (code_queries, outline_queries, search_queries, reference_queries, payload_queries, edit_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
