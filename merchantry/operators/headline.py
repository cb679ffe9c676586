"""Headline metrics, feed statistics and readiness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import exact_sum, floor_days, round_to, safe_div
from merchantry.operators.distinct import with_distinct_counts

TENANT = ["tenant_id"]


def customer_column(columns: Sequence[str]) -> str | None:
    """The customer key is the email if present, else the id."""
    return next((c for c in ("customer_email", "customer_id") if c in columns), None)


def total_revenue(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """D1."""
    return sales.groupBy(*by).agg(F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("total_revenue"))


def active_customers(sales: DataFrame, by: Sequence[str] = TENANT, approximate: bool = False) -> DataFrame:
    """Distinct customer keys; optionally the sketch-based estimate."""
    key = customer_column(sales.columns)
    count = F.approx_count_distinct if approximate else F.countDistinct
    return sales.groupBy(*by).agg((count(key) if key else F.lit(0).cast("bigint")).alias("active_customers"))


def average_order_value(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """D3: mean of the order sums, or of the rows without an order id."""
    if "order_id" in sales.columns:
        sales = sales.where(F.col("order_id").isNotNull()).groupBy(*by, "order_id").agg(F.sum("total").alias("total"))
    return sales.groupBy(*by).agg(
        safe_div(F.sum("total"), F.count("total")).alias("average_order_value")
    )


def recency_churn(
    sales: DataFrame, as_of: Column, by: Sequence[str] = TENANT, days: int = RULES.churn_days
) -> DataFrame:
    """Percent of customers whose last order is more than `days` before `as_of`."""
    key = customer_column(sales.columns)
    groups = sales.groupBy(*by).agg(F.count("*").alias("_rows"))
    if key is None or "order_date" not in sales.columns:
        return groups.select(*by, F.lit(RULES.churn_default_pct).alias("churn_risk_percentage"))
    last = sales.groupBy(*by, key).agg(F.max("order_date").alias("_last"))
    late = floor_days(as_of, F.col("_last")) > days
    dated = F.col("_last").isNotNull() & F.col(key).isNotNull()
    return last.groupBy(*by).agg(
        F.coalesce(
            F.try_divide(F.count_if(late & dated).cast("double"), F.count_if(dated).cast("double")) * 100,
            F.lit(RULES.churn_default_pct),
        ).alias("churn_risk_percentage")
    )


def lifecycle_churn(customers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percent of customers that are lapsed or going quiet."""
    gone = F.count_if(F.col("segment").isin("Lapsed", "Going Quiet"))
    return customers.groupBy(*by).agg(round_to(safe_div(gone, F.count("*")) * 100, 1).alias("churn_risk"))


def repeat_purchase_rate(customers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Percent of customers with at least two orders."""
    repeat = F.count_if("is_repeat_customer")
    return customers.groupBy(*by).agg(round_to(safe_div(repeat, F.count("*")) * 100, 1).alias("repeat_purchase_rate"))


def headline_metrics(sales: DataFrame, customers: DataFrame, by: Sequence[str]) -> DataFrame:
    """The dashboard's headline row per group.

    Customers carry revenue and order counts, so one pass over them gives every
    figure except the order mean, which needs distinct orders of the sales.
    """
    orders = average_order_value(sales, by)
    figures = customers.groupBy(*by).agg(
        exact_sum("total_revenue", 4).alias("total_revenue"),
        F.count("*").alias("active_customers"),
        round_to(
            safe_div(F.count_if(F.col("segment").isin("Lapsed", "Going Quiet")), F.count("*")) * 100, 1
        ).alias("churn_risk"),
        round_to(safe_div(F.count_if("is_repeat_customer"), F.count("*")) * 100, 1).alias("repeat_purchase_rate"),
        F.countDistinct("segment").alias("segment_count"),
    )
    hidden = {"_part"}
    columns = F.array(*[F.lit(c) for c in sorted(c for c in sales.columns if c not in hidden)])
    return figures.join(orders, list(by)).withColumn("columns_found", F.array_join(columns, ","))


def file_stats(sales: DataFrame, file: str = "source_file", by: Sequence[str] = TENANT) -> DataFrame:
    """Rows, date range and revenue per file, with the total row (file null)."""
    per_file = sales.groupBy(*by, file).agg(
        F.count("*").alias("_rows"),
        F.min("order_date").alias("_first"),
        F.max("order_date").alias("_last"),
        F.sum("total").alias("_total"),
    )
    out = per_file.rollup(*by, file).agg(
        F.grouping_id().alias("_level"),
        F.sum("_rows").alias("records"),
        F.coalesce(F.date_format(F.min("_first"), "yyyy-MM-dd"), F.lit("N/A")).alias("start"),
        F.coalesce(F.date_format(F.max("_last"), "yyyy-MM-dd"), F.lit("N/A")).alias("end"),
        F.coalesce(F.sum("_total").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.count("*").alias("files"),
    )
    # Levels 0 and 1: the files, and each group's total; coarser totals are dropped.
    return (
        out.where(F.col("_level") <= 1)
        .withColumn("columns", F.lit(len(sales.columns)).cast("bigint"))
        .drop("_level")
    )


def sales_feed_stats(feed: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Distinct orders and customers, sum and mean of the price."""
    totals = feed.groupBy(*by).agg(
        F.sum("price").cast("double").alias("total_revenue"), safe_div(F.sum("price"), F.count("price")).alias("avg_order_value"),
    )
    return with_distinct_counts(totals, feed, by, {"total_orders": "order_id", "total_customers": "customer_id"})


def product_feed_stats(feed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct categories and the price range."""
    return feed.groupBy(*by).agg(
        F.count("*").alias("total_products"),
        F.countDistinct("category").alias("categories"),
        safe_div(F.sum("price"), F.count("price")).alias("avg_price"),
        F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
    )


def category_performance(sales: DataFrame, products: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Sales joined with products: rows, revenue and customers per category.

    Sales are reduced to one row per product and customer before the join.
    """
    reduced = sales.groupBy(*by, "product_id", "customer_id").agg(
        F.count("order_id").alias("_orders"), F.sum("price").alias("_price")
    )
    return (
        reduced.join(products.select("product_id", "category"), "product_id")
        .groupBy(*by, "category")
        .agg(
            F.sum("_orders").alias("total_orders"),
            F.sum("_price").cast("double").alias("total_revenue"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )


def data_overview(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Rows, columns, distinct customers, orders and products."""
    key = customer_column(sales.columns)
    wanted = {"unique_customers": key, "unique_orders": "order_id", "unique_products": "product_name"}
    there = {name: column for name, column in wanted.items() if column in sales.columns}
    totals = with_distinct_counts(sales.groupBy(*by).agg(F.count("*").alias("total_rows")), sales, by, there)
    return totals.withColumns({name: F.lit(0).cast("bigint") for name in wanted if name not in there}).withColumn(
        "columns_available", F.lit(len(sales.columns)).cast("bigint")
    )


def repeat_readiness(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Whether enough customers have repeat orders."""
    key = customer_column(sales.columns)
    per_customer = sales.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.countDistinct("order_id").alias("_orders"))
    counted = per_customer.groupBy(*by).agg(
        F.count("*").alias("total_customers"),
        F.count_if(F.col("_orders") > 1).alias("customers_with_repeat_orders"),
        F.sum("_orders").alias("_orders"),
    )
    share = safe_div("customers_with_repeat_orders", "total_customers") * 100
    ready = F.col("customers_with_repeat_orders") >= RULES.repeat_ready_customers
    people = F.col("customers_with_repeat_orders").cast("string")
    return counted.select(
        *by,
        "total_customers",
        "customers_with_repeat_orders",
        round_to(share, 1).alias("repeat_customer_percentage"),
        round_to(safe_div("_orders", "total_customers"), 2).alias("avg_orders_per_customer"),
        ready.alias("available"),
        # Readiness messages.
        F.when(
            ready,
            F.concat(
                F.lit("✅ EXCELLENT! You have "), people, F.lit(" customers with multiple orders ("),
                F.format_number(round_to(share, 1), 1), F.lit("%). Perfect for repeat purchase analysis!"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("⚠️ LIMITED: Only "), people,
                F.lit(" customers have multiple orders. Analysis possible but insights will be limited."),
            )
        )
        .alias("recommendation"),
    )


def basket_readiness(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Whether enough orders have several rows; meaningful at line grain."""
    per_order = sales.where(F.col("order_id").isNotNull()).groupBy(*by, "order_id").agg(F.count("*").alias("_rows"))
    counted = per_order.groupBy(*by).agg(
        F.count("*").alias("total_orders"),
        F.count_if(F.col("_rows") > 1).alias("orders_with_multiple_products"),
        F.sum("_rows").alias("_rows"),
    )
    share = safe_div("orders_with_multiple_products", "total_orders") * 100
    ready = F.col("orders_with_multiple_products") >= RULES.basket_ready_orders
    orders = F.col("orders_with_multiple_products").cast("string")
    return counted.select(
        *by,
        "total_orders",
        "orders_with_multiple_products",
        round_to(share, 1).alias("multi_product_percentage"),
        round_to(safe_div("_rows", "total_orders"), 2).alias("avg_products_per_order"),
        ready.alias("available"),
        # Readiness messages.
        F.when(
            ready,
            F.concat(
                F.lit("✅ EXCELLENT! You have "), orders, F.lit(" orders with multiple products ("),
                F.format_number(round_to(share, 1), 1), F.lit("%). Perfect for basket analysis!"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("⚠️ LIMITED: Only "), orders,
                F.lit(" orders have multiple products. Analysis possible but few bundle opportunities will be found."),
            )
        )
        .alias("recommendation"),
    )


def overall_readiness(repeat: DataFrame, basket: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """How many of the two checks pass, with the overall message."""
    both = repeat.select(*by, F.col("available").alias("repeat_available")).join(
        basket.select(*by, F.col("available").alias("basket_available")), list(by), "full"
    )
    passed = (
        F.coalesce(F.col("repeat_available"), F.lit(False)).cast("int")
        + F.coalesce(F.col("basket_available"), F.lit(False)).cast("int")
    )
    # Overall messages.
    message = (
        F.when(
            passed == 2,
            "🎉 PERFECT! Your data supports BOTH advanced features. You can unlock deeper customer insights!",
        )
        .when(passed == 1, "👍 GOOD! Your data supports 1 advanced feature. Some deeper insights available.")
        .otherwise(
            "📊 BASIC: Your data supports overview analytics only. Advanced features need more data structure."
        )
    )
    return both.select(
        *by, passed.cast("bigint").alias("features_available_count"), message.alias("overall_recommendation")
    )
