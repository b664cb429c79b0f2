"""Every registered query and its SQL."""

from __future__ import annotations

from . import align_queries, chain_queries, file_queries, graph_queries, saved_queries, sequence_queries, suffix_queries  # noqa: F401  they fill the registry
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
