"""All registered queries, by family."""

from evalframe.plans import aggregate_queries, file_queries, join_queries, metric_queries, sample_queries, table_queries  # noqa: F401
from evalframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
