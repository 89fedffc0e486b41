"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from larkspur.plans import function_queries, graph_queries, ingest_queries, ranking_queries, stream_queries

MODULES = [ranking_queries, stream_queries, function_queries, graph_queries, ingest_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
