"""All ledger queries by name, and their SQL."""

from __future__ import annotations

from . import file_queries, queries, recon_queries, report_queries, table_queries, whole_queries

QUERIES, SQL = queries.QUERIES, queries.SQL
MODULES = (queries, file_queries, report_queries, recon_queries, table_queries, whole_queries)
