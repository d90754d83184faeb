"""Name -> query, and name -> equivalent SQL, for every operator outside llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query of the form f(spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from quillspark.plans import aggregate_queries, evidence_queries, extraction_queries, graph_queries, index_queries, knowledge_queries, pipeline_queries, relational_queries, retrieval_queries, source_queries, stream_queries  # noqa: F401


load()
