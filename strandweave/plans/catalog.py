"""Registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.plans import event_queries, interval_queries, junction_queries, relation_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = interval_queries.QUERIES | event_queries.QUERIES | junction_queries.QUERIES | relation_queries.QUERIES
ORACLE: dict[str, str] = interval_queries.ORACLE | event_queries.ORACLE | junction_queries.ORACLE | relation_queries.ORACLE
FLAGSHIP = "interval_overlap_join"
