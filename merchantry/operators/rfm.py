"""Recency, frequency, monetary scores and the segments built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import exact_sum, floor_days, safe_div
from merchantry.operators.headline import customer_column
from merchantry.operators.order_statistics import keys_at, quantiles, top_rows, values_at
from merchantry.session import store

TENANT = ["tenant_id"]
QUINTILES = 5

# Segment colours.
SEGMENT_COLOURS = {
    "Champions": "#22c55e",
    "Loyal Customers": "#3b82f6",
    "Cannot Lose Them": "#dc2626",
    "At Risk": "#f97316",
    "Potential Loyalist": "#8b5cf6",
    "New Customers": "#06b6d4",
    "Promising": "#84cc16",
    "Need Attention": "#eab308",
    "Hibernating": "#64748b",
    "High Value": "#8b5cf6",
    "Regular": "#10b981",
    "Low Value": "#f59e0b",
}
DEFAULT_COLOUR = "#94a3b8"

# Segment descriptions.
SEGMENT_DESCRIPTIONS = {
    "Champions": "Best customers - high value, frequent, recent",
    "Loyal Customers": "Consistent customers with good value",
    "Potential Loyalist": "Recent customers with potential",
    "New Customers": "Recently acquired customers",
    "Promising": "New customers with good early signs",
    "Need Attention": "Below average customers needing focus",
    "About To Sleep": "Declining engagement, needs intervention",
    "At Risk": "Haven't purchased recently, at risk of churning",
    "Cannot Lose Them": "High-value customers with declining activity",
    "Hibernating": "Inactive customers with low recent activity",
}
DEFAULT_DESCRIPTION = "Customer segment based on behavior"


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """A small fixed table as a map literal."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def rfm_base(sales: DataFrame, as_of: Column, by: Sequence[str] = TENANT) -> DataFrame:
    """monetary, frequency (rows with a total) and recency in days."""
    key = customer_column(sales.columns)
    dated = "order_date" in sales.columns
    last = F.max("order_date") if dated else F.lit(None).cast("timestamp_ntz")
    base = (
        sales.where(F.col(key).isNotNull())
        .groupBy(*by, F.col(key).alias("customer_key"))
        .agg(
            F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("monetary"),
            F.count("total").alias("frequency"),
            last.alias("_last"),
        )
    )
    if dated:
        days = F.coalesce(floor_days(as_of, F.col("_last")), F.lit(RULES.missing_recency_days))
    else:
        days = F.lit(RULES.undated_recency_days)
    return base.withColumn("recency", days.cast("bigint")).drop("_last")


def rfm_scores(base: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """F2: scores 1–5 by rank, ties in customer order; small recency scores high.

    With n customers, rank r scores max(1, ceil(5 (r - 1) / (n - 1))), so score s
    ends at rank 1 + floor(s (n - 1) / 5). Only the four rows at those ranks are
    looked up per metric; every customer is then compared with them.
    """
    base = store(base, "rfm-base")
    metrics = ["recency", "frequency", "monetary"]
    tall = base.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
        ])).alias("_m"),
        "customer_key",
    ).select(*by, "_m.metric", "_m.value", "customer_key")
    steps = range(1, QUINTILES)
    ends = store(values_at(tall, [*by, "metric"], "value", {
        str(s): (s / QUINTILES, F.lit(1) + F.floor(F.lit(s) * (F.col("n") - 1) / QUINTILES)) for s in steps
    }), "rfm-values")
    among = ends.select(*by, "metric", "label", "value", (F.col("rank") - F.col("smaller")).alias("rank"))
    last = keys_at(tall, [*by, "metric"], "value", "customer_key", among)
    cuts = store(
        last.groupBy(*by).agg(*[
            F.max(F.when((F.col("metric") == m) & (F.col("label") == str(s)), F.struct("value", "customer_key")))
            .alias(f"_{m}{s}")
            for m in metrics
            for s in steps
        ]),
        "rfm-cuts",
    )

    def score(metric: str) -> Column:
        here = F.struct(F.col(metric).cast("double").alias("value"), F.col("customer_key"))
        above = [F.when(here > F.col(f"_{metric}{s}"), 1).otherwise(0) for s in range(1, QUINTILES)]
        return sum(above, F.lit(1))

    return base.join(cuts, list(by)).select(
        *base.columns,
        (F.lit(QUINTILES + 1) - score("recency")).cast("int").alias("r_score"),
        score("frequency").cast("int").alias("f_score"),
        score("monetary").cast("int").alias("m_score"),
    )


def rfm_segment() -> Column:
    """the first rule that matches."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New Customers")
        .when((r >= 3) & (f >= 3) & (m <= 2), "Potential Loyalist")
        .when((r >= 4) & (f >= 2) & (m >= 2), "Promising")
        .when((r <= 2) & (f >= 3) & (m >= 3), "Cannot Lose Them")
        .when((r <= 2) & (f >= 2) & (f <= 3), "At Risk")
        .when((r <= 2) & (f <= 2) & (m >= 3), "Cannot Lose Them")
        .when((r <= 3) & (f <= 2) & (m <= 2), "Hibernating")
        .otherwise("Need Attention")
    )


def rfm_customers(sales: DataFrame, as_of: Column, by: Sequence[str] = TENANT) -> DataFrame:
    return rfm_scores(rfm_base(sales, as_of, by), by).withColumn("segment", rfm_segment())


def rfm_summary(scored: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """customers, revenue, mean revenue and colour per segment."""
    out = scored.groupBy(*by, "segment").agg(
        F.count("*").alias("customers"), exact_sum("monetary", 4).alias("total_revenue")
    )
    return out.withColumn("avg_revenue", safe_div("total_revenue", "customers")).withColumn(
        "color", lookup(F.col("segment"), SEGMENT_COLOURS, DEFAULT_COLOUR)
    )


def rfm_list(summary: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """the summary's segments in list order, most customers first; a group has at most as many rows as segments."""
    order = Window.partitionBy(*by).orderBy(F.desc("customers"), F.asc("segment"))
    return summary.withColumn("position", F.row_number().over(order))


def rfm_top_customers(
    scored: DataFrame, limit: int = RULES.segment_top_customers, by: Sequence[str] = TENANT
) -> DataFrame:
    """the best customers of each segment, with their scores as text."""
    best = top_rows(scored, [*by, "segment"], [F.desc("monetary"), F.asc("customer_key")], limit)
    totals = scored.groupBy(*by, "segment").agg(
        F.count("*").alias("segment_customers"), exact_sum("monetary", 4).alias("segment_revenue")
    )
    scores = F.format_string("R:%d, F:%d, M:%d", "r_score", "f_score", "m_score")
    return best.join(totals, [*by, "segment"]).select(
        *by, "segment", "rank", "customer_key", "monetary", "frequency", "recency", scores.alias("rfm_scores"),
        "segment_customers", "segment_revenue",
    )


def rfm_reconciliation(scored: DataFrame, summary: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """whether the segments keep every customer and all revenue."""
    whole_base = scored.groupBy(*by).agg(
        F.count("*").alias("expected_customers"), exact_sum("monetary", 4).alias("expected_revenue")
    )
    parts = summary.groupBy(*by).agg(
        F.sum("customers").alias("actual_customers"), exact_sum("total_revenue", 4).alias("actual_revenue")
    )
    joined = whole_base.join(parts, list(by))
    same = (F.col("expected_customers") == F.col("actual_customers")) & (
        F.abs(F.col("expected_revenue") - F.col("actual_revenue")) <= 0.01
    )
    return joined.withColumn("reconciled", same)


def revenue_tiers(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """High Value, Regular, Low Value by the 80th and 20th percentile of spend."""
    key = customer_column(sales.columns)
    spend = store(
        sales.where(F.col(key).isNotNull())
        .groupBy(*by, F.col(key).alias("customer_key"))
        .agg(F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("spend")),
        "tier-spend",
    )
    edges = store(quantiles(spend, by, "spend", {"p20": 0.2, "p80": 0.8}), "tier-edges")
    tier = (
        F.when(F.col("spend") >= F.col("p80"), "High Value")
        .when(F.col("spend") >= F.col("p20"), "Regular")
        .otherwise("Low Value")
    )
    counted = (
        spend.join(edges, list(by))
        .groupBy(*by, tier.alias("segment"))
        .agg(F.count("*").alias("customers"), exact_sum("spend", 4).alias("total_revenue"))
    )
    # All three tiers are listed, empty ones with zeros.
    names = F.explode(F.array(F.lit("High Value"), F.lit("Regular"), F.lit("Low Value"))).alias("segment")
    return (
        edges.select(*by, names)
        .join(counted, [*by, "segment"], "left")
        .select(
            *by,
            "segment",
            F.coalesce("customers", F.lit(0).cast("bigint")).alias("customers"),
            F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
            safe_div("total_revenue", "customers").alias("avg_revenue"),
            lookup(F.col("segment"), SEGMENT_COLOURS, DEFAULT_COLOUR).alias("color"),
        )
    )


def described(segments: DataFrame) -> DataFrame:
    """F8: segments with their descriptions."""
    return segments.withColumn("description", lookup(F.col("segment"), SEGMENT_DESCRIPTIONS, DEFAULT_DESCRIPTION))
