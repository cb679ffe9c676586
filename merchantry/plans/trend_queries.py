"""Registered trend queries and their check SQL."""

from __future__ import annotations

from merchantry.operators import trends
from merchantry.plans.sql_tables import with_lines, with_orders
from merchantry.sources.star_schema import sales_lines, sales_orders

QUERIES = {
    "e1_revenue_trend": lambda s, d: trends.revenue_trend(sales_orders(s, d)),
    "e1_revenue_trend_daily": lambda s, d: trends.revenue_trend(sales_orders(s, d), "daily"),
    "e2_aov_trend": lambda s, d: trends.aov_trend(sales_orders(s, d)),
    "e3_order_volume_trend": lambda s, d: trends.order_volume_trend(sales_orders(s, d), "weekly"),
    "e4_new_vs_returning": lambda s, d: trends.new_vs_returning(sales_orders(s, d)),
    "e5_top_products": lambda s, d: trends.top_products(sales_orders(s, d, product=True)),
    "e5_top_products_lines": lambda s, d: trends.top_products(sales_lines(s, d, product=True), 10, "volume"),
    "e6_geo_breakdown": lambda s, d: trends.geo_breakdown(sales_orders(s, d)),
}


def _change(column: str) -> str:
    return (
        f"coalesce(({column} / nullif(lag({column}) OVER (PARTITION BY tenant_id ORDER BY start), 0) - 1) * 100, 0.0)"
    )


def _revenue(period: str, label: str) -> str:
    return with_orders(f"""
, p AS (SELECT tenant_id, date_trunc('{period}', order_date) AS start, CAST(sum(total) AS DOUBLE) AS revenue,
               count(DISTINCT order_id) AS orders FROM sales GROUP BY ALL)
SELECT tenant_id, strftime(start, '{label}') AS period, revenue, orders, {_change('revenue')} AS change_percent FROM p""")


def _products(source: str, measure: str) -> str:
    return f"""
, p AS (SELECT tenant_id, product_name, CAST(sum(total) AS DOUBLE) AS total_revenue,
               CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT order_id) AS unique_orders,
               CAST(sum(CAST(unit_price AS DECIMAL(18,4))) AS DOUBLE) / count(unit_price) AS avg_unit_price
        FROM {source} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {measure} DESC, product_name) AS rank,
             count(*) OVER (PARTITION BY tenant_id) AS total_products FROM p)
SELECT *, CASE WHEN total_quantity > 0 THEN total_revenue / total_quantity ELSE 0.0 END AS revenue_per_unit
FROM r WHERE rank <= 10"""


SQL = {
    "e1_revenue_trend": _revenue("month", "%Y-%m"),
    "e1_revenue_trend_daily": _revenue("day", "%Y-%m-%d"),
    "e2_aov_trend": with_orders(f"""
, p AS (SELECT tenant_id, date_trunc('month', order_date) AS start, CAST(sum(total) AS DOUBLE) AS total_revenue,
               count(DISTINCT order_id) AS total_orders FROM sales GROUP BY ALL),
a AS (SELECT *, total_revenue / total_orders AS aov FROM p)
SELECT tenant_id, strftime(start, '%Y-%m') AS period, aov, total_revenue, total_orders,
       {_change('aov')} AS change_percent FROM a"""),
    "e3_order_volume_trend": with_orders(f"""
, p AS (SELECT tenant_id, date_trunc('week', order_date) AS start, count(DISTINCT order_id) AS order_count,
               sum(quantity) AS items FROM sales GROUP BY ALL)
SELECT tenant_id, strftime(start, '%Y-%m-%d') AS period, order_count, CAST(items AS BIGINT) AS total_items,
       items / order_count AS avg_items_per_order, {_change('order_count')} AS change_percent FROM p"""),
    "e4_new_vs_returning": with_orders("""
, m AS (SELECT tenant_id, customer_id, date_trunc('month', order_date) AS month, total FROM sales),
f AS (SELECT tenant_id, customer_id, min(month) AS first_month FROM m GROUP BY ALL),
j AS (SELECT m.*, month = first_month AS is_new FROM m JOIN f USING (tenant_id, customer_id)),
g AS (SELECT tenant_id, month,
             count(DISTINCT CASE WHEN is_new THEN customer_id END) AS new_customers,
             count(DISTINCT CASE WHEN NOT is_new THEN customer_id END) AS returning_customers,
             CAST(sum(CASE WHEN is_new THEN total ELSE 0 END) AS DOUBLE) AS new_customer_revenue,
             CAST(sum(CASE WHEN is_new THEN 0 ELSE total END) AS DOUBLE) AS returning_customer_revenue
      FROM j GROUP BY ALL)
SELECT tenant_id, strftime(month, '%Y-%m') AS period, new_customers, returning_customers,
       new_customers + returning_customers AS total_customers, new_customer_revenue, returning_customer_revenue,
       returning_customers / (new_customers + returning_customers) * 100 AS returning_percentage FROM g"""),
    "e5_top_products": with_orders(_products("sales", "total_revenue")),
    "e5_top_products_lines": with_lines(_products("lines", "total_quantity")),
    "e6_geo_breakdown": with_orders("""
, g AS (SELECT tenant_id, customer_location AS location, CAST(sum(total) AS DOUBLE) AS total_revenue,
               count(DISTINCT customer_id) AS unique_customers, count(DISTINCT order_id) AS total_orders
        FROM sales GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total_revenue DESC, location) AS rank FROM g)
SELECT *, total_revenue / unique_customers AS avg_revenue_per_customer FROM r WHERE rank <= 20"""),
}
