"""All registered queries."""

from claimweave.plans import merge_queries, opinion_queries, read_queries, score_queries, search_queries, source_queries, stream_queries, text_queries  # noqa: F401
from claimweave.plans.registry import CHECKS, QUERIES, Tables, check_sql

__all__ = ["CHECKS", "QUERIES", "Tables", "check_sql"]
