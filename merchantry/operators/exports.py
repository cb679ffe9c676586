"""Customer lists written as CSV folders, one folder per segment, action or insight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.functions.expressions import day_label, round_to
from merchantry.operators.drilldown import action_customers
from merchantry.operators.segments import effective_segment

TENANT = ["tenant_id"]


def segment_export(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """A10: nine columns per customer."""
    return customers.withColumn("segment", effective_segment()).select(
        *by,
        F.col("customer_key").alias("email_or_id"),
        "segment",
        F.col("total_revenue").alias("total_spent"),
        F.col("order_count").alias("orders"),
        day_label("last_order_date").alias("last_order"),
        round_to("aov", 2).alias("avg_order_value"),
        "days_since_last_order",
        "recommended_action",
        "action_reason",
    )


def action_export(customers: DataFrame, members: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Nine columns per customer and action."""
    listed = action_customers(customers, members, None, by).select(*by, "action_key", F.col("email_or_id").alias("customer_key"))
    return customers.join(listed, [*by, "customer_key"]).select(
        *by,
        "action_key",
        F.col("customer_key").alias("email_or_id"),
        F.col("recommended_action").alias("action"),
        F.col("action_reason").alias("reason"),
        F.col("action_priority").alias("priority"),
        F.col("suggested_channel").alias("channel"),
        F.col("suggested_timing").alias("timing"),
        F.col("total_revenue").alias("total_spent"),
        F.col("order_count").alias("orders"),
        day_label("last_order_date").alias("last_order"),
    )


def insight_export(
    customers: DataFrame, listed: DataFrame, insights: DataFrame, by: Sequence[str] = TENANT
) -> DataFrame:
    """Eight columns per customer an insight lists."""
    texts = insights.select(
        *by, "insight_id", F.col("category").alias("insight_category"), F.col("headline").alias("insight_headline")
    )
    return (
        customers.join(listed.select(*by, "customer_key", "insight_id"), [*by, "customer_key"])
        .join(texts, [*by, "insight_id"])
        .select(
            *by,
            "insight_id",
            F.col("customer_key").alias("email_or_id"),
            "insight_category",
            "insight_headline",
            F.col("total_revenue").alias("total_spent"),
            F.col("order_count").alias("orders"),
            day_label("last_order_date").alias("last_order"),
            "days_since_last_order",
            "segment",
        )
    )


def full_export(
    customers: DataFrame, listed: DataFrame, insights: DataFrame, by: Sequence[str] = TENANT
) -> dict[str, DataFrame]:
    """Segments, actions and insights, every customer in each of the first two.

    A key an insight lists stays even when it has no customer row.
    """
    segments = segment_export(customers, by).drop("days_since_last_order", "action_reason")
    actions = customers.select(
        *by,
        F.col("customer_key").alias("email_or_id"),
        F.col("recommended_action").alias("action"),
        F.col("action_priority").alias("priority"),
        F.col("suggested_channel").alias("channel"),
        F.col("suggested_timing").alias("timing"),
        F.col("action_reason").alias("reason"),
        F.col("total_revenue").alias("total_spent"),
        F.col("order_count").alias("orders"),
        day_label("last_order_date").alias("last_order"),
    )
    about = insights.select(
        *by, "insight_id", "category", "headline", "confidence", "revenue_at_stake", "suggested_action"
    )
    spent = customers.select(*by, "customer_key", F.col("total_revenue").alias("total_spent"), "segment")
    linked = (
        listed.select(*by, "insight_id", "customer_key")
        .join(about, [*by, "insight_id"])
        .join(spent, [*by, "customer_key"], "left")
        .select(
            *by,
            F.col("customer_key").alias("email_or_id"),
            "insight_id", "category", "headline", "confidence", "revenue_at_stake", "suggested_action",
            F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"),
            F.coalesce("segment", F.lit("")).alias("segment"),
        )
    )
    return {"segments": segments, "actions": actions, "insights": linked}


def problem_export(problems: DataFrame, duplicates: DataFrame, keys: Sequence[str] = TENANT) -> DataFrame:
    """Row problems and duplicate orders in one table."""
    repeated = duplicates.select(
        *keys, "row", F.lit("order_id").alias("field"), F.col("order_id").alias("value"),
        F.col("message").alias("error"), "severity",
    )
    columns = [*keys, "row", "field", "value", "error", "severity"]
    return problems.select(*columns).unionByName(repeated.select(*columns))


def write_csv(rows: DataFrame, path: str, folder_by: Sequence[str], compression: str = "none") -> None:
    """Write CSV with a header; one folder per value of `folder_by`, each of as
    many files as its rows need, packed by `compression` if named."""
    rows.hint("rebalance", *folder_by).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).option("compression", compression).partitionBy(*folder_by).csv(path)
