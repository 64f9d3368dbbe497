"""All queries of the page-analytics part, by name, with their DuckDB oracles."""

from __future__ import annotations

from pagelens.plans import keyword_queries, page_queries, table_queries

MODULES = (page_queries, keyword_queries, table_queries)
FLAGSHIP = "n6_top_phrases"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
