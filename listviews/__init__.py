"""List views over the given tables, and every operator as a query with its reference SQL."""

from . import (  # noqa: F401
    dedup_queries,
    dictionary_queries,
    match_queries,
    rule_queries,
    run_queries,
    source_queries,
    spec_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
