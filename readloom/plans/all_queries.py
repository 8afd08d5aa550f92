"""All queries of the library, registered by import."""

from readloom.plans import aggregate_queries, file_queries, filter_queries, function_queries, join_queries, model_queries  # noqa: F401
from readloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
