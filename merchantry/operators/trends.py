"""Revenue, order value, volume, product, location and new-versus-returning trends."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import finite, pct_change, period_label, period_start, safe_div
from merchantry.operators.distinct import with_distinct_counts
from merchantry.operators.headers import LOCATION_COLUMNS, LOCATION_MARKS
from merchantry.operators.headline import customer_column
from merchantry.operators.order_statistics import top_rows
from merchantry.session import store

TENANT = ["tenant_id"]


def _by_period(sales: DataFrame, period: str, by: Sequence[str], quantity: bool = False) -> DataFrame:
    aggregates = [F.sum("total").alias("_revenue"), F.countDistinct("order_id").alias("orders")]
    if quantity:
        aggregates.append(F.sum("quantity").alias("_items"))
    return (
        sales.where(F.col("order_date").isNotNull())
        .groupBy(*by, period_start("order_date", period).alias("_start"))
        .agg(*aggregates)
    )


def _previous(column: str, by: Sequence[str]) -> Column:
    # One row per period: a group is as long as its calendar.
    return F.lag(column).over(Window.partitionBy(*by).orderBy("_start"))


def revenue_trend(sales: DataFrame, period: str = "monthly", by: Sequence[str] = TENANT) -> DataFrame:
    """Revenue, distinct orders and revenue change per period present."""
    return _by_period(sales, period, by).withColumn("revenue", F.col("_revenue").cast("double")).select(
        *by,
        period_label(F.col("_start"), period).alias("period"),
        "revenue",
        "orders",
        pct_change(F.col("revenue"), _previous("revenue", by)).alias("change_percent"),
    )


def aov_trend(sales: DataFrame, period: str = "monthly", by: Sequence[str] = TENANT) -> DataFrame:
    """Revenue per distinct order and its change."""
    base = (
        _by_period(sales, period, by)
        .withColumn("total_revenue", F.col("_revenue").cast("double"))
        .withColumn("aov", safe_div("total_revenue", "orders"))
    )
    return base.select(
        *by,
        period_label(F.col("_start"), period).alias("period"),
        "aov",
        "total_revenue",
        F.col("orders").alias("total_orders"),
        pct_change(F.col("aov"), _previous("aov", by)).alias("change_percent"),
    )


def order_volume_trend(sales: DataFrame, period: str = "monthly", by: Sequence[str] = TENANT) -> DataFrame:
    """Distinct orders, items, items per order, change of the order count."""
    has_items = "quantity" in sales.columns
    base = _by_period(sales, period, by, quantity=has_items)
    items = F.coalesce(F.col("_items"), F.lit(0.0)) if has_items else F.lit(0.0)
    return base.select(
        *by,
        period_label(F.col("_start"), period).alias("period"),
        F.col("orders").alias("order_count"),
        items.cast("bigint").alias("total_items"),
        safe_div(items, "orders").alias("avg_items_per_order"),
        pct_change(F.col("orders"), _previous("orders", by)).alias("change_percent"),
    )


def _customer(sales: DataFrame, named: str | None) -> str:
    key = named or customer_column(sales.columns)
    if key is None:
        raise ValueError("no customer column")
    return key


def new_vs_returning(sales: DataFrame, customer: str | None = None, by: Sequence[str] = TENANT) -> DataFrame:
    """A customer is new in the month of the first order, returning later. Customers are told apart by email, else id.

    Rows are first reduced to one per customer and month, so the step that finds
    each customer's first month sees at most one row per month.
    """
    customer = _customer(sales, customer)
    monthly = (
        sales.where(F.col("order_date").isNotNull())
        .groupBy(*by, customer, period_start("order_date", "monthly").alias("_start"))
        .agg(F.sum("total").alias("_revenue"))
    )
    first = F.min("_start").over(Window.partitionBy(*by, customer))
    is_new = F.col("_start") == F.col("_first")
    zero = F.lit(0).cast("decimal(18,4)")
    out = (
        monthly.withColumn("_first", first)
        .groupBy(*by, "_start")
        .agg(
            F.count_if(is_new).alias("new_customers"),
            F.count_if(~is_new).alias("returning_customers"),
            F.sum(F.when(is_new, F.col("_revenue")).otherwise(zero)).cast("double").alias("new_customer_revenue"),
            F.sum(F.when(is_new, zero).otherwise(F.col("_revenue"))).cast("double").alias("returning_customer_revenue"),
        )
        .withColumn("total_customers", F.col("new_customers") + F.col("returning_customers"))
    )
    return out.select(
        *by,
        period_label(F.col("_start"), "monthly").alias("period"),
        "new_customers",
        "returning_customers",
        "total_customers",
        "new_customer_revenue",
        "returning_customer_revenue",
        (safe_div("returning_customers", "total_customers") * 100).alias("returning_percentage"),
    )


def product_stats(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Per product: revenue, quantity, distinct orders, mean price, revenue per unit."""
    columns = set(sales.columns)
    quantity = F.sum("quantity") if "quantity" in columns else F.lit(0)
    # Exact decimals keep the mean price independent of row order.
    price = F.col("unit_price").cast("decimal(18,4)") if "unit_price" in columns else F.lit(None).cast("decimal(18,4)")
    stats = (
        sales.where(F.col("product_name").isNotNull())
        .groupBy(*by, "product_name")
        .agg(
            F.sum("total").cast("double").alias("total_revenue"),
            F.coalesce(quantity, F.lit(0)).cast("bigint").alias("total_quantity"),
            F.countDistinct("order_id").alias("unique_orders"),
            F.sum(price).cast("double").alias("_prices"),
            F.count(price).alias("_priced"),
        )
    )
    return stats.select(
        *by,
        "product_name",
        "total_revenue",
        "total_quantity",
        "unique_orders",
        safe_div("_prices", "_priced").alias("avg_unit_price"),
        F.when(F.col("total_quantity") > 0, safe_div("total_revenue", "total_quantity"))
        .otherwise(0.0)
        .alias("revenue_per_unit"),
    )


def top_products(
    sales: DataFrame, limit: int = 10, sort_by: str = "revenue", by: Sequence[str] = TENANT
) -> DataFrame:
    """E5: the best products by revenue or volume, with the product count."""
    stats = product_stats(sales, by)
    measure = "total_quantity" if sort_by == "volume" and "quantity" in sales.columns else "total_revenue"
    totals = stats.groupBy(*by).agg(F.count("*").alias("total_products"))
    best = top_rows(stats, by, [F.desc(measure), F.asc("product_name")], limit)
    return best.join(totals, list(by))


def location_column(columns: Sequence[str]) -> str | None:
    """The preferred location column, else the first that looks like one."""
    for name in LOCATION_COLUMNS:
        if name in columns:
            return name
    return next((c for c in columns if re.search(LOCATION_MARKS, c.lower())), None)


def geo_breakdown(
    sales: DataFrame, limit: int = RULES.geo_rows, customer: str | None = None, by: Sequence[str] = TENANT
) -> DataFrame:
    """Locations by revenue, with customers, orders and revenue per customer."""
    place = location_column(sales.columns)
    if place is None:
        raise ValueError("no location column")
    customer = _customer(sales, customer)
    placed = sales.where(F.col(place).isNotNull()).select(*by, F.col(place).cast("string").alias("location"), customer, "order_id", "total")
    revenue = placed.groupBy(*by, "location").agg(F.sum("total").cast("double").alias("total_revenue"))
    # Only the places that are listed are counted.
    best = store(top_rows(revenue, by, [F.desc("total_revenue"), F.asc("location")], limit), "locations")
    listed = placed.join(best.select(*by, "location"), [*by, "location"], "left_semi")
    out = with_distinct_counts(best, listed, [*by, "location"], {"unique_customers": customer, "total_orders": "order_id"})
    return out.withColumn("avg_revenue_per_customer", safe_div("total_revenue", "unique_customers"))


def monthly_revenue(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Revenue per month present."""
    return (
        sales.where(F.col("order_date").isNotNull())
        .groupBy(*by, period_start("order_date", "monthly").alias("month"))
        .agg(finite(F.sum("total").cast("double")).alias("revenue"))
    )
