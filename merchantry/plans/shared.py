"""Tables that many registered queries read, stored once per session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from merchantry.operators import growth_plan
from merchantry.operators.customers import customer360
from merchantry.operators.explanations import explained
from merchantry.operators.insights import group_marks, insight_members, insights, portfolio
from merchantry.session import store_packed as store
from merchantry.sources.star_schema import UPLOAD, sales_orders

_stored: dict[tuple[str, str, str], DataFrame] = {}


def reset() -> None:
    """Forget the stored tables, so that the next query builds its own."""
    _stored.clear()


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def orders_table(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned order table with product columns."""
    return _once(spark, folder, "orders", lambda: store(sales_orders(spark, folder, product=True), "orders"))


def customers_table(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table, one row per export and customer."""
    return _once(
        spark, folder, "customers",
        lambda: store(customer360(orders_table(spark, folder), UPLOAD), "customers"),
    )


def best_actions_table(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their scored recommendations, stored, and the best one's texts, made where they are read."""
    return explained(_once(
        spark, folder, "best-actions",
        lambda: store(growth_plan.chosen(customers_table(spark, folder)), "best-actions"),
    ))


def acted_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The customer table with the best recommendation written onto each row."""
    return growth_plan.acted(best_actions_table(spark, folder), customers_table(spark, folder))


def members_table(spark: SparkSession, folder: str) -> DataFrame:
    return growth_plan.plan_members(best_actions_table(spark, folder), UPLOAD)


def plan_table(spark: SparkSession, folder: str) -> DataFrame:
    return growth_plan.plan_actions(members_table(spark, folder), UPLOAD)


def marks_table(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "marks", lambda: group_marks(customers_table(spark, folder), UPLOAD))


def insights_table(spark: SparkSession, folder: str) -> DataFrame:
    return _once(
        spark, folder, "insights",
        lambda: store(
            insights(portfolio(customers_table(spark, folder), marks_table(spark, folder), UPLOAD), UPLOAD), "insights"
        ),
    )


def insight_members_table(spark: SparkSession, folder: str) -> DataFrame:
    return insight_members(
        customers_table(spark, folder), marks_table(spark, folder), insights_table(spark, folder), UPLOAD
    )
