"""The registered queries of the reference's operators, and their DuckDB statements."""

from __future__ import annotations

from . import document_queries, event_queries, graph_queries, legal_queries, linked_queries, mixed_queries, more_queries, quality_queries, ranking_queries, search_queries, store_queries, text_queries, worded_queries
from .registry import Query

_REGISTRIES = [text_queries.r, event_queries.r, graph_queries.r, mixed_queries.r, more_queries.r, search_queries.r, ranking_queries.r, document_queries.r, store_queries.r, quality_queries.r, legal_queries.r, linked_queries.r, worded_queries.r]


def queries() -> dict[str, Query]:
    return {k: v for r in _REGISTRIES for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _REGISTRIES for k, v in r.sql.items()}
