"""All queries of the redaction operators and their SQL."""

from __future__ import annotations

from . import json_queries, list_queries, nested_queries, queries

QUERIES = {**queries.QUERIES, **json_queries.QUERIES, **nested_queries.QUERIES, **list_queries.QUERIES}
ORACLES = {**queries.ORACLES, **json_queries.ORACLES, **nested_queries.ORACLES, **list_queries.ORACLES}
