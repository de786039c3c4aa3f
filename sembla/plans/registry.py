"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sembla.plans import media_queries, problem_queries, source_queries, stream_queries, vector_queries

_MODULES = [problem_queries, vector_queries, media_queries, source_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that entry() runs."""
    return queries()["knn_l2"](spark, sf_dir)
