"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from marlstone.plans import evidence_queries, investigation_queries, market_queries, pair_queries, scan_queries, statement_queries

_ALL = (market_queries, pair_queries, evidence_queries, investigation_queries, statement_queries, scan_queries)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _ALL for name, sql in module.ORACLE.items()}
