"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievestone.plans import answers, pages, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | pages.QUERIES | answers.QUERIES
ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | pages.ORACLE_SQL | answers.ORACLE_SQL
