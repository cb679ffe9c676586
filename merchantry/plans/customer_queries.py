"""Registered queries over the customer table and its segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchantry.operators import customers as c
from merchantry.operators import segments as g
from merchantry.operators import headline as d
from merchantry.operators.customer_state import update_customers
from merchantry.operators.dashboard import dashboard
from merchantry.plans.shared import customers_table, orders_table
from merchantry.plans.headline_queries import smoothed_sql
from merchantry.plans.sql_customers import CUSTOMERS, with_customers
from merchantry.plans.sql_tables import with_orders
from merchantry.session import new_table_path
from merchantry.sources.snapshots import load_snapshot
from merchantry.sources.star_schema import UPLOAD, sales_orders


def _dates_as_text(df):
    names = [n for n, t in df.dtypes if t in ("timestamp_ntz", "timestamp", "date")]
    return df.withColumns({n: F.date_format(F.col(n).cast("timestamp_ntz"), "yyyy-MM-dd") for n in names})


def _customers(s, d_):
    return customers_table(s, d_)


def _summary(s, folder):
    return g.segment_summary(customers_table(s, folder), UPLOAD)


def _previous(summary):
    """Each export's summary, moved to the following year's export."""
    return summary.withColumn("upload_id", (F.col("upload_id").cast("int") + 1).cast("string"))


def _stored_stale(s, folder):
    """Stored customers whose flags were worked out on another day."""
    stale = ["is_lapsed", "is_new_customer", "is_at_risk", "is_high_value", "segment", "days_since_last_order"]
    return customers_table(s, folder).drop(*stale)


def _dashboard(s, folder):
    rows = dashboard(orders_table(s, folder), customers_table(s, folder), UPLOAD)
    ahead = F.filter("revenue_forecast", lambda m: m["type"] == "forecast")
    return rows.select(
        *UPLOAD,
        "total_revenue",
        F.size("revenue_forecast").alias("forecast_rows"),
        ahead[0]["period"].alias("next_period"),
        ahead[0]["revenue"].alias("next_revenue"),
        F.array_join(F.transform("customer_segments", lambda x: x["segment"]), ",").alias("segments"),
    )


CORE = [
    *UPLOAD, "customer_key", "total_revenue", "order_count", "first_order_date", "last_order_date",
    "total_quantity_purchased", "total_discount_amount", "refund_total", "net_revenue", "aov", "days_since_last_order",
    "customer_lifetime_days", "purchase_frequency", "discount_usage_rate", "reference_date",
]
FLAGS = [
    "is_repeat_customer", "is_one_time_buyer", "is_lapsed", "is_discount_dependent", "is_full_price_loyal",
    "is_high_value", "is_new_customer", "is_at_risk", "is_high_return_risk",
]
PRODUCTS = ["distinct_products_purchased", "first_product_purchased", "most_bought_product"]
ACTION = ["recommended_action", "action_reason", "action_priority", "suggested_channel", "suggested_timing"]

def _some_unnamed(sales):
    """Orders of which some name no customer: null, blank or white space alone."""
    number = F.col("customer_id").cast("bigint")
    return sales.withColumn("customer_id", F.when(number % 7 == 0, "").when(number % 11 == 0, "  ").when(number % 13 != 0, F.col("customer_id")))


def _incremental(s, f):
    """The customer table after batches of orders of which one brings one merchant alone and is run again."""
    path = new_table_path(s, "customer-state")
    orders = orders_table(s, f)
    lane = F.pmod(F.xxhash64("order_id"), F.lit(3))
    one = F.col("tenant_id") == "BUILDING"
    alone = (lane == 1) & one
    for part, rows in (("a", lane == 0), ("b", alone), ("b", alone), ("c", (lane > 0) & ~alone)):
        update_customers(orders.where(rows), path, part)
    return load_snapshot(s, f"{path}/customers")


QUERIES = {
    "g2_incremental_customers": lambda s, f: _dates_as_text(_incremental(s, f).select(
        *CORE, *[c for c in [*FLAGS, *PRODUCTS, "segment"] if c not in CORE])),
    "c15_skipped_rows": lambda s, f: c.skipped_rows(_some_unnamed(sales_orders(s, f)), UPLOAD),
    "d5_lifecycle_churn": lambda s, f: d.lifecycle_churn(_customers(s, f), UPLOAD),
    "d6_repeat_purchase_rate": lambda s, f: d.repeat_purchase_rate(_customers(s, f), UPLOAD),
    "d7_headline_metrics": lambda s, f: d.headline_metrics(orders_table(s, f), _customers(s, f), UPLOAD),
    "d7_dashboard": _dashboard,
    "g1_reference_date": lambda s, f: _dates_as_text(
        c.group_figures(_customers(s, f), UPLOAD, F.lit("2000-06-30").cast("date"))
    ),
    "g2_customer_totals": lambda s, f: _dates_as_text(_customers(s, f).select(*CORE)),
    "g7_order_gaps": lambda s, f: c.order_gaps(c.keyed_rows(orders_table(s, f)), [*UPLOAD, "customer_key"]),
    "g8_product_preferences": lambda s, f: _customers(s, f).select(*UPLOAD, "customer_key", *PRODUCTS),
    "g11_customer_flags": lambda s, f: _customers(s, f).select(*UPLOAD, "customer_key", *FLAGS, "avg_days_between_orders"),
    "g13_lifecycle_segment": lambda s, f: _customers(s, f).select(*UPLOAD, "customer_key", "segment"),
    "g14_baseline_action": lambda s, f: _customers(s, f).select(*UPLOAD, "customer_key", *ACTION),
    "g15_segment_summary": lambda s, f: g.segment_list(_summary(s, f), UPLOAD),
    "g16_weekly_actions": lambda s, f: g.weekly_actions(_customers(s, f), UPLOAD),
    "g17_refresh_flags": lambda s, f: c.refresh_flags(_stored_stale(s, f), UPLOAD).select(
        *UPLOAD, "customer_key", "days_since_last_order", *FLAGS, "segment"
    ),
    "g18_segment_enrichment": lambda s, f: g.segment_enrichment(_summary(s, f), _customers(s, f), UPLOAD),
    "g19_segment_trends": lambda s, f: g.segment_trends(_summary(s, f), _previous(_summary(s, f)), UPLOAD),
    "g20_what_changed": lambda s, f: g.what_changed(_summary(s, f), _previous(_summary(s, f)), UPLOAD),
    "g21_risk_and_opportunity": lambda s, f: g.risk_and_opportunity(_customers(s, f), UPLOAD),
    "g22_merge_enrichment": lambda s, f: g.merge_enrichment(
        _summary(s, f),
        _previous(g.segment_enrichment(_summary(s, f), _customers(s, f), UPLOAD)).drop("color", "why", "how_to_treat"),
        UPLOAD,
    ),
}

_COLOURS = """CASE segment WHEN 'VIPs' THEN '#7C3AED' WHEN 'Regulars' THEN '#2563EB' WHEN 'New Customers' THEN '#059669'
  WHEN 'One-Time Buyers' THEN '#D97706' WHEN 'Going Quiet' THEN '#DC2626' WHEN 'Lapsed' THEN '#6B7280' ELSE '#EA580C' END"""

_SUMMARY = f"""
, summary AS (
  SELECT tenant_id, upload_id, segment, count(*) AS customers,
         CAST(round(sum(CAST(total_revenue AS DECIMAL(38,4))), 2) AS DOUBLE) AS total_revenue,
         floor(CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_revenue,
         {_COLOURS} AS color
  FROM customers GROUP BY ALL),
previous AS (SELECT * REPLACE (CAST(CAST(upload_id AS INT) + 1 AS VARCHAR) AS upload_id) FROM summary)"""

_SHARE = """
, revenue AS (SELECT tenant_id, upload_id, CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS all_revenue
              FROM customers GROUP BY ALL),
shares AS (SELECT summary.*, floor(total_revenue / greatest(all_revenue, 1.0) * 100 * 10 + 0.5) / 10 AS revenue_pct
           FROM summary JOIN revenue USING (tenant_id, upload_id))"""

# Benchmark texts by segment.
_TEXTS = """
, texts(segment, description, why, how_to_treat, typical_pct, benchmark_note) AS (VALUES
 ('VIPs', 'Your highest-value, full-price loyal buyers.', 'They generate the most revenue and buy without needing a discount — protecting them from promotion lists preserves your margins.', 'Reward with exclusivity (early access, personal notes) — never with discounts.', '5–10% of customers, 25–40% of revenue', 'Healthy brands see VIPs at 5–10% of base. Below 5%? Focus on converting Regulars up.'),
 ('Regulars', 'Repeat buyers who purchase at a steady pace.', 'These customers drive the backbone of your recurring revenue and are most likely to refer others.', 'Stay top of mind with consistent communication. Personalise by most-bought product.', '15–25% of customers, 30–40% of revenue', 'If Regulars are under 15%, your second-purchase conversion needs work.'),
 ('New Customers', 'First-time buyers in the last 30 days.', 'The 30-day post-purchase window is the highest-leverage retention moment. Most churn happens here.', 'Send an onboarding sequence (3–4 emails, not automated welcome spam). Make them feel noticed.', '10–20% per month in a growing brand', 'New customers should be turning into Regulars within 60 days — if not, check your onboarding.'),
 ('One-Time Buyers', 'Customers who bought exactly once.', '60–80% of first-time buyers never return without a specific nudge. This is your biggest revenue leak.', 'Send a second-purchase nudge at 30–45 days. Use the product they bought to personalise.', '30–50% of total base — should shrink over time', 'If One-Time Buyers exceed 50% of your base, your retention is your #1 problem.'),
 ('Going Quiet', 'Repeat buyers who are overdue by their own standards.', 'They''ve shown they can buy again — they just haven''t. Targeted re-engagement recovers 10–20% of this group.', 'Personal re-engagement email referencing their last product. Not a batch discount blast.', '5–15% of customers', 'Going Quiet above 15%? Your email frequency or relevance may be slipping.'),
 ('Lapsed', 'Customers with no purchase in 180+ days.', 'Still worth trying — the cost to win back a lapsed customer is 5× cheaper than acquiring a new one.', 'One targeted win-back attempt, then move them to a low-frequency list. Don''t spam.', 'Under 15% is healthy — above 25% signals a retention emergency', 'Lapsed above 20% means your brand is not keeping customers engaged past a single season.'),
 ('Discount Shoppers', 'Buyers who used a discount on 70%+ of their orders.', 'Discount-dependent customers squeeze margin and anchor to sale prices — over time they only buy on promotion.', 'Test removing them from the next promotion. Some will buy anyway. The ones who don''t — that''s their true LTV.', 'Under 15% is healthy', 'If Discount Shoppers are above 20%, check whether your promotions are training buyers to wait.'))"""

_DELTAS = """
, joined AS (
  SELECT s.*, p.customers AS prev_customers, s.customers - p.customers AS delta, s.total_revenue - p.total_revenue AS gain
  FROM summary s LEFT JOIN previous p USING (tenant_id, upload_id, segment))"""

WEEKLY_ACTIONS = """
, firsts2 AS (SELECT tenant_id, upload_id, recommended_action, suggested_channel, suggested_timing FROM customers
  QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, recommended_action ORDER BY customer_key) = 1),
grp AS (SELECT tenant_id, upload_id, recommended_action, action_priority, count(*) AS customer_count,
  CAST(round(sum(CAST(total_revenue AS DECIMAL(38,4))), 2) AS DOUBLE) AS total_revenue_at_stake FROM customers GROUP BY ALL)
SELECT tenant_id, upload_id, recommended_action AS action, action_priority, customer_count, total_revenue_at_stake,
  suggested_channel, suggested_timing, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY
    CASE action_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, customer_count DESC, recommended_action) AS position
FROM grp JOIN firsts2 USING (tenant_id, upload_id, recommended_action)"""

SQL = {
    "c15_skipped_rows": with_orders(
        """, named AS (SELECT *, CAST(customer_id AS BIGINT) AS c FROM sales)
SELECT tenant_id, upload_id, count(*) FILTER (WHERE c % 7 <> 0 AND c % 11 <> 0 AND c % 13 <> 0) AS kept_rows,
  count(*) FILTER (WHERE c % 7 = 0 OR c % 11 = 0 OR c % 13 = 0) AS skipped_rows FROM named GROUP BY ALL"""
    ),
    "d5_lifecycle_churn": with_customers(
        "SELECT tenant_id, upload_id, floor(count(*) FILTER (WHERE segment IN ('Lapsed','Going Quiet')) / count(*) * 100 * 10 + 0.5) / 10 AS churn_risk FROM customers GROUP BY ALL"
    ),
    "d6_repeat_purchase_rate": with_customers(
        "SELECT tenant_id, upload_id, floor(count(*) FILTER (WHERE order_count >= 2) / count(*) * 100 * 10 + 0.5) / 10 AS repeat_purchase_rate FROM customers GROUP BY ALL"
    ),
    "d7_headline_metrics": with_customers("""
, o AS (SELECT tenant_id, upload_id, order_id, sum(total) AS t FROM sales GROUP BY ALL),
a AS (SELECT tenant_id, upload_id, CAST(sum(t) AS DOUBLE) / count(*) AS average_order_value FROM o GROUP BY ALL)
SELECT tenant_id, upload_id, CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue,
  count(*) AS active_customers, any_value(average_order_value) AS average_order_value,
  floor(count(*) FILTER (WHERE segment IN ('Lapsed','Going Quiet')) / count(*) * 100 * 10 + 0.5) / 10 AS churn_risk,
  floor(count(*) FILTER (WHERE order_count >= 2) / count(*) * 100 * 10 + 0.5) / 10 AS repeat_purchase_rate,
  count(DISTINCT segment) AS segment_count,
  'category,customer_id,customer_location,customer_name,discount_amount,financial_status,order_date,order_id,product_id,product_name,quantity,refund_amount,subtotal,tenant_id,total,unit_price,upload_id' AS columns_found
FROM customers JOIN a USING (tenant_id, upload_id) GROUP BY ALL"""),
    "d7_dashboard": "WITH RECURSIVE " + CUSTOMERS + _SUMMARY + """
, months AS (SELECT tenant_id, upload_id, date_trunc('month', order_date) AS month, CAST(sum(total) AS DOUBLE) AS revenue FROM sales GROUP BY ALL)"""
    + smoothed_sql("tenant_id, upload_id") + """
, ahead AS (SELECT tenant_id, upload_id, count(*) AS forecast_rows, arg_min(revenue, month) FILTER (WHERE type = 'forecast') AS next_revenue,
            strftime(min(month) FILTER (WHERE type = 'forecast'), '%Y-%m') AS next_period FROM rows2 GROUP BY ALL),
listed AS (SELECT tenant_id, upload_id, string_agg(segment, ',' ORDER BY total_revenue DESC) AS segments FROM summary GROUP BY ALL),
whole AS (SELECT tenant_id, upload_id, CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue FROM customers GROUP BY ALL)
SELECT * FROM whole JOIN ahead USING (tenant_id, upload_id) JOIN listed USING (tenant_id, upload_id)""",
    "g1_reference_date": with_customers("""
SELECT tenant_id, upload_id, count(*) AS customers,
  strftime(least(DATE '2000-06-30', CAST(max(last_order_date) AS DATE)), '%Y-%m-%d') AS reference_date,
  floor(quantile_cont(total_revenue, 0.8) * 10000 + 0.5) / 10000 AS high_value_from
FROM customers GROUP BY ALL"""),
    "g2_incremental_customers": with_customers(f"""
SELECT {', '.join(
    f"strftime({n}, '%Y-%m-%d') AS {n}" if n in ("first_order_date", "last_order_date", "reference_date") else n
    for n in [*CORE, *[c for c in [*FLAGS, *PRODUCTS, "segment"] if c not in CORE]])} FROM customers"""),
    "g2_customer_totals": with_customers(f"""
SELECT {', '.join(
    f"strftime({n}, '%Y-%m-%d') AS {n}" if n in ("first_order_date", "last_order_date", "reference_date") else n
    for n in CORE)} FROM customers"""),
    "g7_order_gaps": with_customers(
        "SELECT tenant_id, upload_id, customer_key, coalesce(avg_gap, -1.0) AS avg_days_between_orders FROM gaps"
    ),
    "g8_product_preferences": with_customers(
        f"SELECT tenant_id, upload_id, customer_key, {', '.join(PRODUCTS)} FROM customers"
    ),
    "g11_customer_flags": with_customers(
        f"SELECT tenant_id, upload_id, customer_key, {', '.join(FLAGS)}, avg_days_between_orders FROM customers"
    ),
    "g13_lifecycle_segment": with_customers("SELECT tenant_id, upload_id, customer_key, segment FROM customers"),
    "g14_baseline_action": with_customers(
        f"SELECT tenant_id, upload_id, customer_key, {', '.join(ACTION)} FROM customers"
    ),
    "g15_segment_summary": with_customers(_SUMMARY + """
SELECT *, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY total_revenue DESC, segment) AS position FROM summary"""),
    "g16_weekly_actions": with_customers(WEEKLY_ACTIONS),
    "g17_refresh_flags": with_customers(
        f"SELECT tenant_id, upload_id, customer_key, days_since_last_order, {', '.join(FLAGS)}, segment FROM customers"
    ),
    "g18_segment_enrichment": with_customers(
        _SUMMARY + _SHARE + _TEXTS + "SELECT * FROM shares JOIN texts USING (segment)"
    ),
    "g19_segment_trends": with_customers(_SUMMARY + _DELTAS + """
SELECT * EXCLUDE (prev_customers, delta, gain), coalesce(delta, 0) AS delta_customers,
  floor(coalesce(gain, 0.0) * 100 + 0.5) / 100 AS delta_revenue FROM joined"""),
    "g20_what_changed": with_customers(_SUMMARY + _DELTAS + """
, totals2 AS (SELECT tenant_id, upload_id, CAST(sum(customers) AS BIGINT) AS total, count(*) AS segs,
                     count(*) FILTER (WHERE delta <> 0) AS changes FROM joined GROUP BY ALL),
prevs AS (SELECT tenant_id, upload_id, CAST(sum(customers) AS BIGINT) AS prev_total FROM previous GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY abs(delta) DESC, total_revenue DESC) AS r
            FROM joined WHERE delta <> 0),
tops AS (SELECT * FROM ordered WHERE r = 1),
concerns AS (SELECT tenant_id, upload_id, segment AS concern, delta AS concern_delta FROM ordered
  WHERE segment IN ('Lapsed','Going Quiet') AND delta > 0
  QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY r) = 1)
SELECT tenant_id, upload_id, CASE WHEN prev_total IS NULL
  THEN 'This is your first upload — ' || total || ' customers across ' || segs || ' segments have been profiled.'
  ELSE 'Your total customer base is ' || CASE WHEN total > prev_total THEN 'up' WHEN total < prev_total THEN 'down' ELSE 'unchanged' END
    || ' ' || abs(total - prev_total) || CASE WHEN abs(total - prev_total) = 1 THEN ' customer' ELSE ' customers' END || ' (now ' || total || ').'
    || coalesce(' Biggest shift: ' || t.segment || CASE WHEN t.delta > 0 THEN ' grew by ' ELSE ' shrank by ' END || abs(t.delta)
        || CASE WHEN abs(t.delta) = 1 THEN ' customer' ELSE ' customers' END || CASE WHEN t.delta > 0 THEN ' (↑£' ELSE ' (↓£' END
        || format('{:,}', CAST(round_even(abs(t.gain), 0) AS BIGINT)) || ' revenue).', '')
    || CASE WHEN changes > 1 THEN coalesce(' Watch out: ' || concern || ' grew by ' || concern_delta || ' — consider a re-engagement campaign.', '') ELSE '' END
  END AS what_changed
FROM totals2 LEFT JOIN prevs USING (tenant_id, upload_id) LEFT JOIN tops t USING (tenant_id, upload_id)
LEFT JOIN concerns USING (tenant_id, upload_id)"""),
    "g21_risk_and_opportunity": with_customers("""
SELECT tenant_id, upload_id,
  CAST(round(sum(CASE WHEN is_lapsed OR is_at_risk THEN CAST(total_revenue AS DECIMAL(38,4)) ELSE 0 END), 2) AS DOUBLE) AS revenue_at_risk,
  CAST(round(sum(CASE WHEN is_new_customer OR (is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60)
                      THEN CAST(total_revenue AS DECIMAL(38,4)) ELSE 0 END), 2) AS DOUBLE) AS revenue_opportunity
FROM customers GROUP BY ALL"""),
    "g22_merge_enrichment": with_customers(_SUMMARY + _SHARE + _TEXTS + """
, cached AS (SELECT tenant_id, CAST(CAST(upload_id AS INT) + 1 AS VARCHAR) AS upload_id, segment, revenue_pct, description,
                    typical_pct, benchmark_note FROM shares JOIN texts USING (segment))
SELECT * FROM summary LEFT JOIN cached USING (tenant_id, upload_id, segment)"""),
}
