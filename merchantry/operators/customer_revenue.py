"""Revenue per customer: statistics, quartiles, the best customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import exact_sum, floor_days, safe_div
from merchantry.operators.headline import customer_column
from merchantry.operators.order_statistics import quantiles, top_rows
from merchantry.session import store

TENANT = ["tenant_id"]


def customer_revenue(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Revenue, distinct orders, dates, lifetime and revenue per order."""
    key = customer_column(sales.columns)
    dated = "order_date" in sales.columns
    aggregates = [
        F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.countDistinct("order_id").alias("total_orders"),
    ]
    if dated:
        aggregates += [F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order")]
    stats = sales.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("customer_key")).agg(*aggregates)
    lifetime = F.coalesce(floor_days(F.col("last_order"), F.col("first_order")) + 1, F.lit(1)) if dated else F.lit(1)
    return stats.withColumn("lifetime_days", lifetime.cast("bigint")).withColumn(
        "revenue_per_order", safe_div("total_revenue", "total_orders")
    )


def revenue_quartiles(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Low, Medium, High or Premium by quartile; All where edges repeat."""
    customers = store(customers, "customer-revenue")
    edges = store(
        quantiles(customers, by, "total_revenue", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, extremes=True), "quartile-edges"
    )
    distinct = (
        (F.col("lowest") < F.col("q1"))
        & (F.col("q1") < F.col("q2"))
        & (F.col("q2") < F.col("q3"))
        & (F.col("q3") < F.col("highest"))
    )
    revenue = F.col("total_revenue")
    # Quartile names.
    quartile = (
        F.when(~distinct, "All")
        .when(revenue <= F.col("q1"), "Low")
        .when(revenue <= F.col("q2"), "Medium")
        .when(revenue <= F.col("q3"), "High")
        .otherwise("Premium")
    )
    return customers.join(edges, list(by)).withColumn("revenue_quartile", quartile).drop(
        "n", "q1", "q2", "q3", "lowest", "highest"
    )


def quartile_summary(quartiled: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One row per quartile, and the summary row (segment null)."""
    out = quartiled.rollup(*by, "revenue_quartile").agg(
        F.grouping_id().alias("_level"),
        F.count("*").alias("customer_count"),
        safe_div(exact_sum("total_revenue", 4), F.count("*")).alias("avg_revenue_per_customer"),
        exact_sum("total_revenue", 4).alias("total_segment_revenue"),
        safe_div(F.sum("total_orders"), F.count("*")).alias("avg_orders_per_customer"),
        safe_div(exact_sum("revenue_per_order"), F.count("*")).alias(
            "avg_revenue_per_order"
        ),
        safe_div(F.sum("lifetime_days"), F.count("*")).alias("avg_customer_lifetime_days"),
    )
    listed = (F.col("_level") == 1) | ((F.col("_level") == 0) & (F.col("revenue_quartile") != "All"))
    return out.where(listed).withColumnRenamed("revenue_quartile", "segment").drop("_level")


def top_customers(customers: DataFrame, limit: int = RULES.top_customers, by: Sequence[str] = TENANT) -> DataFrame:
    """The best customers by revenue."""
    best = top_rows(customers, by, [F.desc("total_revenue"), F.asc("customer_key")], limit)
    return best.select(*by, "rank", "customer_key", "total_revenue", "total_orders", "revenue_per_order", "lifetime_days")
