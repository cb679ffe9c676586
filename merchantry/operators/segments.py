"""Lifecycle segment summaries, their changes between exports, weekly action summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.expressions import exact_sum, plural, pounds, round_to, safe_div
from merchantry.operators.catalogue import (
    PRIORITY_ORDER, SEGMENT_BENCHMARKS, SEGMENT_COLOURS, SEGMENT_DEFAULT_COLOUR, Benchmark,
)
from merchantry.operators.customers import second_purchase_window, segment_rule
from merchantry.operators.rfm import lookup

TENANT = ["tenant_id"]


def cents(total: Column) -> Column:
    """An exact decimal amount rounded to two places, as double."""
    return F.round(total, 2).cast("double")


def effective_segment() -> Column:
    """The stored segment, else the rule's."""
    return F.when(F.length(F.trim(F.col("segment"))) > 0, F.col("segment")).otherwise(segment_rule())


def segment_summary(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Customers, revenue, mean revenue and colour per segment."""
    amount = F.sum(F.col("total_revenue").cast("decimal(38,4)"))
    return customers.groupBy(*by, "segment").agg(
        F.count("*").alias("customers"),
        cents(amount).alias("total_revenue"),
        round_to(safe_div(amount, F.count("*")), 2).alias("avg_revenue"),
    ).withColumn("color", lookup(F.col("segment"), SEGMENT_COLOURS, SEGMENT_DEFAULT_COLOUR))


def segment_list(summary: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The summary's segments in list order, most revenue first; a group has at most as many rows as segments."""
    order = Window.partitionBy(*by).orderBy(F.desc("total_revenue"), F.asc("segment"))
    return summary.withColumn("position", F.row_number().over(order))


def segment_enrichment(summary: DataFrame, customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Share of revenue and benchmark texts per segment."""
    totals = customers.groupBy(*by).agg(exact_sum("total_revenue", 4).alias("_all"))
    share = round_to(F.col("total_revenue") / F.greatest(F.col("_all"), F.lit(1.0)) * 100, 1)
    out = summary.join(totals, list(by)).withColumn("revenue_pct", share).drop("_all")
    texts = {
        field: lookup(F.col("segment"), {s: getattr(b, field) for s, b in SEGMENT_BENCHMARKS.items()}, "")
        for field in Benchmark._fields
    }
    return out.withColumns(texts)


def segment_trends(current: DataFrame, previous: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Change of customers and revenue since the previous export; 0 if new."""
    before = previous.select(
        *by, "segment", F.col("customers").alias("_customers"), F.col("total_revenue").alias("_revenue")
    )
    return (
        current.join(before, [*by, "segment"], "left")
        .withColumn(
            "delta_customers", F.coalesce(F.col("customers") - F.col("_customers"), F.lit(0)).cast("bigint")
        )
        .withColumn(
            "delta_revenue", round_to(F.coalesce(F.col("total_revenue") - F.col("_revenue"), F.lit(0.0)), 2)
        )
        .drop("_customers", "_revenue")
    )


def what_changed(current: DataFrame, previous: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """A short text on what changed since the previous export."""
    before = previous.select(
        *by, "segment", F.col("customers").alias("_customers"), F.col("total_revenue").alias("_revenue")
    )
    earlier = previous.groupBy(*by).agg(F.sum("customers").alias("_prev_total"))
    delta = F.col("customers") - F.col("_customers")
    gain = F.col("total_revenue") - F.col("_revenue")
    # Largest change first; equal changes by revenue.
    change = F.when(
        delta != 0,
        F.struct(
            (-F.abs(delta)).alias("size"), (-F.col("total_revenue")).alias("by"), F.col("segment").alias("segment"),
            delta.alias("delta"), gain.alias("gain"),
        ),
    )
    worse = F.col("segment").isin("Lapsed", "Going Quiet") & (delta > 0)
    grouped = (
        current.join(before, [*by, "segment"], "left")
        .groupBy(*by)
        .agg(
            F.sum("customers").alias("_total"),
            F.count("*").alias("_segments"),
            F.count(change).alias("_changes"),
            F.min(change).alias("_top"),
            F.min(F.when(worse, change)).alias("_concern"),
        )
        .join(earlier, list(by), "left")
    )
    total, moved = F.col("_total"), F.col("_total") - F.col("_prev_total")
    top, concern = F.col("_top"), F.col("_concern")

    def text(value: Column) -> Column:
        return value.cast("string")

    # Sentence patterns.
    first = F.concat(
        F.lit("This is your first upload — "), text(total), F.lit(" customers across "), text(F.col("_segments")),
        F.lit(" segments have been profiled."),
    )
    base = F.concat(
        F.lit("Your total customer base is "),
        F.when(moved > 0, "up").when(moved < 0, "down").otherwise("unchanged"),
        F.lit(" "), text(F.abs(moved)), F.lit(" customer"), plural(F.abs(moved)),
        F.lit(" (now "), text(total), F.lit(")."),
    )
    shift = F.concat(
        F.lit("Biggest shift: "), top["segment"], F.lit(" "),
        F.when(top["delta"] > 0, "grew by").otherwise("shrank by"),
        F.lit(" "), text(F.abs(top["delta"])), F.lit(" customer"), plural(F.abs(top["delta"])),
        F.lit(" ("), F.when(top["delta"] > 0, "↑").otherwise("↓"), pounds(F.abs(top["gain"])), F.lit(" revenue)."),
    )
    warning = F.when(
        F.col("_changes") > 1,
        F.concat(
            F.lit("Watch out: "), concern["segment"], F.lit(" grew by "), text(concern["delta"]),
            F.lit(" — consider a re-engagement campaign."),
        ),
    )
    return grouped.select(
        *by,
        F.when(F.col("_prev_total").isNull(), first).otherwise(F.concat_ws(" ", base, shift, warning)).alias("what_changed"),
    )


def risk_and_opportunity(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Revenue of lapsed or at-risk customers, and of new or nearly repeating ones."""
    revenue = F.col("total_revenue").cast("decimal(38,4)")
    nothing = F.lit(0).cast("decimal(38,4)")
    at_risk = F.col("is_lapsed") | F.col("is_at_risk")
    chance = F.col("is_new_customer") | second_purchase_window()
    return customers.groupBy(*by).agg(
        cents(F.sum(F.when(at_risk, revenue).otherwise(nothing))).alias("revenue_at_risk"),
        cents(F.sum(F.when(chance, revenue).otherwise(nothing))).alias("revenue_opportunity"),
    )


def merge_enrichment(fresh: DataFrame, cached: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Fresh figures, with what only the cached rows hold added by segment."""
    keys = [*by, "segment"]
    extra = [c for c in cached.columns if c not in fresh.columns]
    return fresh.join(cached.select(*keys, *extra), keys, "left")


def priority_rank(priority: Column, unknown: int) -> Column:
    pairs = [F.lit(x) for item in PRIORITY_ORDER.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[priority], F.lit(unknown))


def weekly_actions(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Customers and revenue per recommended action, high priority first.

    Channel and timing come from the action's first customer, in key order.
    """
    grouped = customers.groupBy(*by, "recommended_action", "action_priority").agg(
        F.count("*").alias("customer_count"),
        cents(F.sum(F.col("total_revenue").cast("decimal(38,4)"))).alias("total_revenue_at_stake"),
        F.min(F.struct("customer_key", "suggested_channel", "suggested_timing")).alias("_first"),
    )
    # At most one row per action and priority reaches these windows.
    first = F.min("_first").over(Window.partitionBy(*by, "recommended_action"))
    order = Window.partitionBy(*by).orderBy(
        priority_rank(F.col("action_priority"), 3), F.desc("customer_count"), F.asc("recommended_action")
    )
    return grouped.withColumn("_first", first).select(
        *by,
        F.row_number().over(order).alias("position"),
        F.col("recommended_action").alias("action"),
        "action_priority",
        "customer_count",
        "total_revenue_at_stake",
        F.col("_first.suggested_channel").alias("suggested_channel"),
        F.col("_first.suggested_timing").alias("suggested_timing"),
    )
