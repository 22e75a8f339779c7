"""All queries over the standard tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from keymoment.plans import api_queries, base_queries, lexical_queries, rank_queries, registry, vector_queries

MODULES = (vector_queries, lexical_queries, rank_queries, base_queries, api_queries)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
