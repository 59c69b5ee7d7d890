"""All named queries of the core, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.plans import corpus_queries, evaluation_queries, graph_queries, knowledge_queries, retrieval_queries, session_queries

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (corpus_queries, graph_queries, retrieval_queries, session_queries, evaluation_queries, knowledge_queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The link packs of the stated questions."""
    return retrieval_queries.link_pack(spark, d)


def queries() -> dict[str, Query]:
    return {name: q for group in GROUPS for name, q in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
