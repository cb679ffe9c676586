"""Registered queries that show one operator of a larger table on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchantry.functions.expressions import day_label
from merchantry.operators import segments
from merchantry.plans import customer_queries, headline_queries, ingest_queries, insight_queries, recommendation_queries
from merchantry.plans.shared import customers_table
from merchantry.plans.sql_customers import with_customers
from merchantry.sources.star_schema import TENANT, UPLOAD

KEYS = [*UPLOAD, "customer_key"]


def _part(family, name, *columns, where=None):
    """The named columns, and rows, of a registered query and of its SQL."""
    def run(s, f):
        rows = family.QUERIES[name](s, f)
        return (rows if where is None else rows.where(where)).select(*columns)

    text = f"SELECT {', '.join(columns)} FROM ({family.SQL[name]}) WHERE {where or 'TRUE'}"
    return run, text


PARTS = {
    "c7_order_ids": _part(ingest_queries, "c6_valid_rows", "tenant_id", "upload_id", "o_orderkey", "l_partkey", "order_id"),
    "c8_product_names": _part(
        ingest_queries, "c6_valid_rows", "tenant_id", "upload_id", "o_orderkey", "l_partkey", "product_name"
    ),
    "c11_final_check": _part(ingest_queries, "c12_clean_orders", "tenant_id", "upload_id", "order_id", "customer_email", "total"),
    "e11_revenue_summary": _part(
        headline_queries, "e9_quartile_summary", "tenant_id", "customer_count", "total_segment_revenue",
        "avg_revenue_per_customer", "avg_orders_per_customer", "avg_revenue_per_order", where="segment IS NULL",
    ),
    "e14_backcast": _part(
        headline_queries, "e13_smoothing_forecast", "tenant_id", "period", "revenue", "predicted_revenue",
        where="type = 'validation'",
    ),
    "e17_period_labels": _part(headline_queries, "e13_smoothing_forecast", "tenant_id", "period", "display_name"),
    "g3_average_order_value": _part(customer_queries, "g2_customer_totals", *KEYS, "aov"),
    "g4_recency": _part(
        customer_queries, "g2_customer_totals", *KEYS, "days_since_last_order", "customer_lifetime_days", "purchase_frequency"
    ),
    "g5_discount_usage": _part(customer_queries, "g2_customer_totals", *KEYS, "discount_usage_rate", "total_discount_amount"),
    "g6_net_revenue": _part(customer_queries, "g2_customer_totals", *KEYS, "refund_total", "net_revenue"),
    "g9_most_bought_product": _part(customer_queries, "g8_product_preferences", *KEYS, "most_bought_product"),
    "g10_high_value_threshold": _part(customer_queries, "g1_reference_date", *UPLOAD, "customers", "high_value_from"),
    "g12_at_risk": _part(customer_queries, "g11_customer_flags", *KEYS, "is_at_risk", "avg_days_between_orders"),
    "h4_urgency": _part(recommendation_queries, "h8_scores", *KEYS, "recommendation_id", "urgency"),
    "h5_business_impact": _part(recommendation_queries, "h8_scores", *KEYS, "recommendation_id", "business_impact"),
    "h6_confidence": _part(recommendation_queries, "h8_scores", *KEYS, "recommendation_id", "confidence"),
    "h7_customer_value": _part(recommendation_queries, "h8_scores", *KEYS, "recommendation_id", "customer_value"),
    "i12_insight_confidence": _part(insight_queries, "i13_insights", *UPLOAD, "insight_id", "affected_count", "confidence"),
}

# One query per insight rule, by its place in the rules.
INSIGHT_RULES = [
    "retention-lapsed-high-value", "retention-at-risk-high-value", "retention-overall-lapse-rate",
    "growth-first-to-second-window", "growth-full-price-loyalists", "discount-dependency", "cohort-low-repeat-rate",
    "cohort-new-customer-quality",
]
for _place, _rule in enumerate(INSIGHT_RULES, 1):
    PARTS[f"i{_place}_{_rule.replace('-', '_')}"] = _part(
        insight_queries, "i13_insights", *UPLOAD, "headline", "revenue_at_stake", "affected_count", "score",
        where=f"insight_id = '{_rule}'",
    )


def _labels(s, f):
    """The last order as a label, for every customer."""
    return customers_table(s, f).select(*KEYS, day_label("last_order_date").alias("last_order"))


def _stored_or_inferred(s, f):
    """The stored label of one-time buyers is blank, and worked out again."""
    blanked = F.when(F.col("is_repeat_customer"), F.col("segment")).otherwise("")
    return customers_table(s, f).withColumn("segment", blanked).select(*KEYS, segments.effective_segment().alias("segment"))


def _all_merchants(s, f):
    """L1: the segment summary with exports, and with merchants as groups, from one table."""
    customers = customers_table(s, f)
    by_upload = segments.segment_summary(customers, UPLOAD)
    by_tenant = segments.segment_summary(customers, TENANT).withColumn("upload_id", F.lit("all"))
    return by_upload.unionByName(by_tenant).select(*UPLOAD, "segment", "customers", "total_revenue")


QUERIES = {
    **{name: run for name, (run, _) in PARTS.items()},
    "j6_date_labels": _labels,
    "j9_effective_segment": _stored_or_inferred,
    "l1_all_merchants": _all_merchants,
}

_SUMS = "segment, count(*) AS customers, CAST(round(sum(CAST(total_revenue AS DECIMAL(38,4))), 2) AS DOUBLE) AS total_revenue"

SQL = {
    **{name: text for name, (_, text) in PARTS.items()},
    "j6_date_labels": with_customers(
        "SELECT tenant_id, upload_id, customer_key, strftime(last_order_date, '%d %b %Y') AS last_order FROM customers"
    ),
    "j9_effective_segment": with_customers("SELECT tenant_id, upload_id, customer_key, segment FROM customers"),
    "l1_all_merchants": with_customers(
        f"SELECT tenant_id, upload_id, {_SUMS} FROM customers GROUP BY tenant_id, upload_id, segment "
        f"UNION ALL SELECT tenant_id, 'all' AS upload_id, {_SUMS} FROM customers GROUP BY tenant_id, segment"
    ),
}
