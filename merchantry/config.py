"""Every threshold used by the rules, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # Customer flags.
    lapsed_days: int = 180
    new_days: int = 30
    discount_dependent_rate: float = 0.70
    high_value_quantile: float = 0.80
    high_value_min_customers: int = 5
    at_risk_gap_multiple: float = 2.0
    return_risk_rate: float = 0.30
    window_from_days: int = 30
    window_to_days: int = 60

    # Headline metrics.
    churn_days: int = 60
    churn_default_pct: float = 15.0
    missing_recency_days: int = 365
    undated_recency_days: int = 30
    repeat_ready_customers: int = 5
    basket_ready_orders: int = 10

    # Presentation limits.
    geo_rows: int = 20
    top_customers: int = 10
    segment_top_customers: int = 5
    insight_member_rows: int = 200


RULES = Rules()
