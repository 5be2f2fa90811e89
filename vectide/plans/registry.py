"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import queries, service_queries

QUERIES = queries.QUERIES | service_queries.QUERIES
SQL = queries.SQL | service_queries.SQL
