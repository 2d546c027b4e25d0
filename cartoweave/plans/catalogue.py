"""All queries of the core, by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartoweave.plans import count_queries, map_queries, nested_queries, queue_queries, stream_queries, text_queries

_MODULES = (nested_queries, text_queries, count_queries, map_queries, queue_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
