"""All registered queries and check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.plans import (
    customer_queries, headline_queries, ingest_queries, insight_queries, recommendation_queries, single_queries, store_queries,
    trend_queries,
)

FAMILIES = [store_queries, ingest_queries, trend_queries, headline_queries, customer_queries, recommendation_queries, insight_queries, single_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
