"""Queries over the test tables, each with the same query as SQL, and the mask pipeline."""

from . import file_queries, graph_queries, space_queries, stats_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "file_queries", "graph_queries", "space_queries", "stats_queries"]
