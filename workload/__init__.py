"""Queries over the given tables, each with the SQL it is checked against."""

from workload import content, crawl, dates_and_types, discovery, exports, increments, metadata, sources, streams, urls  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
