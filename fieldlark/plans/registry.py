"""Every registered query of the sensing operators, with its DuckDB twin."""

from __future__ import annotations

from fieldlark.plans import contract_queries, frame_queries, room_queries

QUERIES = frame_queries.QUERIES | room_queries.QUERIES | contract_queries.QUERIES
ORACLE_SQL = frame_queries.ORACLE_SQL | room_queries.ORACLE_SQL | contract_queries.ORACLE_SQL
