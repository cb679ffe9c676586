"""The dashboard row of an export, and the whole run from raw rows to every table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.config import RULES, Rules
from merchantry.operators import growth_plan, insights, segments
from merchantry.operators.customers import customer360
from merchantry.operators.forecast import forecast
from merchantry.operators.headline import headline_metrics
from merchantry.operators.trends import monthly_revenue
from merchantry.session import store

UPLOAD = ["tenant_id", "upload_id"]


def dashboard(sales: DataFrame, customers: DataFrame, by: Sequence[str] = UPLOAD) -> DataFrame:
    """Headline figures with the forecast and the segments nested.

    Both lists are short: a group has one row per month, and seven segments.
    """
    ahead = forecast(monthly_revenue(sales, by), by)
    month = F.struct("period", "display_name", "revenue", "predicted_revenue", "type")
    forecasts = ahead.groupBy(*by).agg(F.array_sort(F.collect_list(month)).alias("revenue_forecast"))
    summary = segments.segment_enrichment(segments.segment_summary(customers, by), customers, by)
    segment = F.struct(
        (-F.col("total_revenue")).alias("order"), "segment", "customers", "total_revenue", "avg_revenue", "revenue_pct",
        "color",
    )
    listed = summary.groupBy(*by).agg(F.array_sort(F.collect_list(segment)).alias("_segments"))
    return (
        headline_metrics(sales, customers, by)
        .join(forecasts, list(by), "left")
        .join(listed, list(by), "left")
        .withColumn("customer_segments", F.transform("_segments", lambda s: s.dropFields("order")))
        .drop("_segments")
    )


class Results(NamedTuple):
    customers: DataFrame
    segments: DataFrame
    risk: DataFrame
    recommendations: DataFrame
    plan_members: DataFrame
    plan_actions: DataFrame
    insights: DataFrame
    insight_members: DataFrame


def run_export(
    sales: DataFrame, by: Sequence[str] = UPLOAD, as_of: Column | None = None, rules: Rules = RULES
) -> Results:
    """From cleaned sales to customers, segments, recommendations, plan and insights.

    The customer table is computed once, stored, and read by everything after it.
    """
    customers = store(customer360(store(sales, "sales"), by, as_of, rules), "customers")
    best = store(growth_plan.recommended(customers), "best-actions")
    members = growth_plan.plan_members(best, by)
    marks = insights.group_marks(customers, by)
    fired = store(insights.insights(insights.portfolio(customers, marks, by), by), "insights")
    summary = segments.segment_summary(customers, by)
    return Results(
        customers=growth_plan.acted(best, customers),
        segments=segments.segment_enrichment(summary, customers, by),
        risk=segments.risk_and_opportunity(customers, by),
        recommendations=best,
        plan_members=members,
        plan_actions=growth_plan.plan_actions(members, by),
        insights=fired,
        insight_members=insights.insight_members(customers, marks, fired, by),
    )
