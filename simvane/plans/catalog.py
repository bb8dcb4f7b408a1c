"""Queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simvane.plans import file_queries, model_queries, selection_queries, table_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = vector_queries.QUERIES | table_queries.QUERIES | model_queries.QUERIES | selection_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL: dict[str, str] = vector_queries.SQL | table_queries.SQL | model_queries.SQL | selection_queries.SQL | file_queries.SQL
