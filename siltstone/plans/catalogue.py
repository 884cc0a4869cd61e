"""Queries by name over a folder of tables, and the same in SQL."""

from __future__ import annotations

from . import function_queries, page_queries, queue_queries, report_queries, scan_queries, storage_queries

QUERIES: dict = {**function_queries.Q, **queue_queries.Q, **report_queries.Q, **storage_queries.Q, **scan_queries.Q, **page_queries.Q}
ORACLES: dict[str, str] = {**function_queries.SQL, **queue_queries.SQL, **report_queries.SQL, **storage_queries.SQL, **scan_queries.SQL, **page_queries.SQL}
