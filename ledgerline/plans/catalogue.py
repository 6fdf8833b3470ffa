"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import customer_queries, evidence_queries, feed_queries, match_queries, order_queries, paper_queries, reading_queries, row_queries, stream_queries, trace_queries, upkeep_queries

_PARTS = [trace_queries, order_queries, match_queries, paper_queries, reading_queries, row_queries, evidence_queries, customer_queries, upkeep_queries, feed_queries, stream_queries]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
