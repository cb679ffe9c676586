"""Registered queries: headline metrics, customer revenue, forecast, RFM."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchantry.operators import customer_revenue as e
from merchantry.operators import forecast as fc
from merchantry.operators import headline as d
from merchantry.operators import rfm
from merchantry.operators.baskets import basket_pairs
from merchantry.operators.trends import monthly_revenue
from merchantry.plans.sql_tables import with_lines, with_orders
from merchantry.sources.star_schema import TENANT, sales_lines, sales_orders, table

AS_OF = "2001-08-02"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _rfm(s, f):
    return rfm.rfm_customers(sales_orders(s, f), _as_of())


def _dated(df):
    names = [n for n, t in df.dtypes if t in ("timestamp_ntz", "timestamp", "date")]
    return df.withColumns({n: F.date_format(F.col(n).cast("timestamp_ntz"), "yyyy-MM-dd") for n in names})


def _sales_feed(s, f):
    """A sales feed: one row per order line with its price."""
    return sales_lines(s, f).withColumn("price", F.col("total"))


def _product_feed(s, f):
    return table(s, f, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("price"),
    )


def _files(s, f):
    """Order lines with the file they came in: one per merchant, year and nation."""
    return sales_lines(s, f).withColumn("source_file", F.concat_ws("/", "upload_id", "customer_location"))


def _series(s, f):
    return fc.monthly_series(monthly_revenue(sales_orders(s, f)))


QUARTER = ["tenant_id", "quarter"]


def _quarter_series(s, f):
    """Short series: the months of every quarter."""
    day = F.col("order_date").cast("date")
    quarter = F.concat_ws("-Q", F.year(day).cast("string"), F.quarter(day).cast("string"))
    return fc.monthly_series(monthly_revenue(sales_orders(s, f).withColumn("quarter", quarter), QUARTER), QUARTER)


def _location_forecast(s, f):
    keys = ["tenant_id", "customer_location"]
    return fc.forecast(monthly_revenue(sales_orders(s, f), keys), keys)


QUERIES = {
    "d1_total_revenue": lambda s, f: d.total_revenue(sales_orders(s, f)),
    "d2_active_customers": lambda s, f: d.active_customers(sales_orders(s, f)),
    "d3_average_order_value": lambda s, f: d.average_order_value(sales_lines(s, f)),
    "d4_recency_churn": lambda s, f: d.recency_churn(sales_orders(s, f), _as_of()),
    "d8_file_stats": lambda s, f: d.file_stats(_files(s, f)),
    "d9_sales_feed_stats": lambda s, f: d.sales_feed_stats(_sales_feed(s, f)),
    "d10_product_feed_stats": lambda s, f: d.product_feed_stats(_product_feed(s, f)),
    "d11_category_performance": lambda s, f: d.category_performance(_sales_feed(s, f), _product_feed(s, f)),
    "d12_data_overview": lambda s, f: d.data_overview(sales_lines(s, f, product=True)),
    "d13_repeat_readiness": lambda s, f: d.repeat_readiness(sales_orders(s, f)),
    "d14_basket_readiness": lambda s, f: d.basket_readiness(sales_lines(s, f)),
    "d15_overall_readiness": lambda s, f: d.overall_readiness(
        d.repeat_readiness(sales_orders(s, f)), d.basket_readiness(sales_lines(s, f))
    ),
    "l5_basket_pairs": lambda s, f: basket_pairs(sales_lines(s, f), min_orders=2, item="product_id"),
    "e7_customer_revenue": lambda s, f: _dated(e.customer_revenue(sales_orders(s, f))),
    "e8_revenue_quartiles": lambda s, f: e.revenue_quartiles(e.customer_revenue(sales_orders(s, f))).select(
        *TENANT, "customer_key", "revenue_quartile"
    ),
    "e9_quartile_summary": lambda s, f: e.quartile_summary(e.revenue_quartiles(e.customer_revenue(sales_orders(s, f)))),
    "e10_top_customers": lambda s, f: e.top_customers(e.customer_revenue(sales_orders(s, f))),
    "e12_monthly_revenue": lambda s, f: _dated(monthly_revenue(sales_orders(s, f))),
    "e13_smoothing_forecast": lambda s, f: fc.smoothing_forecast(_series(s, f)),
    "e15_fit_quality": lambda s, f: fc.fit_quality(_series(s, f)),
    "e16_simple_forecast": lambda s, f: fc.simple_forecast(_quarter_series(s, f), QUARTER),
    "e18_chart_series": lambda s, f: fc.chart_series(fc.forecast(monthly_revenue(sales_orders(s, f)))),
    "f1_rfm_base": lambda s, f: rfm.rfm_base(sales_orders(s, f), _as_of()),
    "f2_rfm_scores": lambda s, f: rfm.rfm_scores(rfm.rfm_base(sales_orders(s, f), _as_of())),
    "f3_rfm_segments": lambda s, f: _rfm(s, f).select(*TENANT, "customer_key", "segment"),
    "f4_rfm_summary": lambda s, f: rfm.rfm_list(rfm.rfm_summary(_rfm(s, f))),
    "f5_rfm_top_customers": lambda s, f: rfm.rfm_top_customers(_rfm(s, f)),
    "f6_rfm_reconciliation": lambda s, f: (lambda c: rfm.rfm_reconciliation(c, rfm.rfm_summary(c)))(_rfm(s, f)),
    "f7_revenue_tiers": lambda s, f: rfm.revenue_tiers(sales_orders(s, f)),
    "f8_segment_descriptions": lambda s, f: rfm.described(rfm.rfm_summary(_rfm(s, f))).select(
        *TENANT, "segment", "description"
    ),
    "l4_location_forecast": _location_forecast,
}

_REVENUE = """
, spend AS (
  SELECT tenant_id, customer_id AS customer_key, CAST(sum(total) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
    min(order_date) AS first_order, max(order_date) AS last_order,
    CAST(floor((epoch(max(order_date)) - epoch(min(order_date))) / 86400) + 1 AS BIGINT) AS lifetime_days
  FROM sales GROUP BY ALL),
stats AS (SELECT *, total_revenue / total_orders AS revenue_per_order FROM spend)"""

_QUARTILES = _REVENUE + """
, edges AS (SELECT tenant_id, quantile_cont(total_revenue, 0.25) AS q1, quantile_cont(total_revenue, 0.5) AS q2,
    quantile_cont(total_revenue, 0.75) AS q3, min(total_revenue) AS lo, max(total_revenue) AS hi FROM stats GROUP BY ALL),
quart AS (SELECT stats.*, CASE WHEN NOT (lo < q1 AND q1 < q2 AND q2 < q3 AND q3 < hi) THEN 'All'
    WHEN total_revenue <= q1 THEN 'Low' WHEN total_revenue <= q2 THEN 'Medium' WHEN total_revenue <= q3 THEN 'High'
    ELSE 'Premium' END AS revenue_quartile FROM stats JOIN edges USING (tenant_id))"""

_SUMS = """count(*) AS customer_count,
  CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) / count(*) AS avg_revenue_per_customer,
  CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS total_segment_revenue,
  CAST(sum(total_orders) AS DOUBLE) / count(*) AS avg_orders_per_customer,
  CAST(sum(CAST(floor(revenue_per_order * 1000000 + 0.5) / 1000000 AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS avg_revenue_per_order,
  CAST(sum(lifetime_days) AS DOUBLE) / count(*) AS avg_customer_lifetime_days"""

_MONTHS = """
, months AS (SELECT tenant_id, date_trunc('month', order_date) AS month, CAST(sum(total) AS DOUBLE) AS revenue FROM sales GROUP BY ALL)"""


def smoothed_sql(keys: str) -> str:
    """The smoother as a recursive query over numbered months."""
    return f"""
, numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM months),
raw AS (SELECT *, CASE WHEN i >= n - 4 THEN (i - (n - 5)) * (i - (n - 5)) ELSE 1 END::DOUBLE AS rw FROM numbered WHERE n >= 6),
weighted AS (SELECT *, rw / sum(rw) OVER (PARTITION BY {keys}) * n AS w FROM raw),
starts AS (SELECT {keys}, any_value(n) AS n,
    (max(CASE WHEN i = 0 THEN revenue END) * max(CASE WHEN i = 0 THEN w END) + max(CASE WHEN i = 1 THEN revenue END) * max(CASE WHEN i = 1 THEN w END)
      + max(CASE WHEN i = 2 THEN revenue END) * max(CASE WHEN i = 2 THEN w END))
    / (max(CASE WHEN i = 0 THEN w END) + max(CASE WHEN i = 1 THEN w END) + max(CASE WHEN i = 2 THEN w END)) AS level,
    max(CASE WHEN i = 1 THEN revenue END) - max(CASE WHEN i = 0 THEN revenue END) AS trend
  FROM weighted GROUP BY {keys}),
fit AS (
  SELECT {keys}, n, CAST(0 AS BIGINT) AS i, level, trend FROM starts
  UNION ALL
  SELECT {keys}, n, i, lv AS level,
    least(0.6::DOUBLE, 0.3::DOUBLE * w) * (lv - level) + (1.0::DOUBLE - least(0.6::DOUBLE, 0.3::DOUBLE * w)) * trend AS trend
  FROM (SELECT f.* EXCLUDE (i), s.i, s.w,
          least(0.8::DOUBLE, 0.4::DOUBLE * s.w) * s.revenue + (1.0::DOUBLE - least(0.8::DOUBLE, 0.4::DOUBLE * s.w)) * (f.level + f.trend) AS lv
        FROM fit f JOIN weighted s USING ({keys}) WHERE s.i = f.i + 1)),
state AS (SELECT {keys}, level, trend, n FROM fit WHERE i = n - 1),
joined AS (SELECT m.*, level, trend FROM numbered m JOIN state s USING ({keys})),
back AS (SELECT *, greatest(0.0::DOUBLE, 0.85::DOUBLE * (level + trend * (i - n + 1)) + 0.15::DOUBLE * revenue) AS predicted FROM joined WHERE i >= n - 2),
rows2 AS (
  SELECT {keys}, month, revenue, CAST(NULL AS DOUBLE) AS predicted_revenue, 'actual' AS type FROM joined WHERE i < n - 2
  UNION ALL SELECT {keys}, month, revenue, predicted, 'validation' FROM back
  UNION ALL SELECT {keys}, CAST(month + to_months(CAST(h AS INT)) AS TIMESTAMP), greatest(0.0::DOUBLE, level + trend * h), NULL, 'forecast'
    FROM joined, range(1, 4) t(h) WHERE i = n - 1)"""


def _forecast_sql(keys: str) -> str:
    """The smoother, and the simple forecast for series under six months."""
    return smoothed_sql(keys) + f"""
, tails AS (SELECT {keys}, max(month) AS month, max(CASE WHEN i = n - 3 THEN revenue END) AS a, max(CASE WHEN i = n - 2 THEN revenue END) AS b,
            max(CASE WHEN i = n - 1 THEN revenue END) AS c FROM numbered WHERE n BETWEEN 3 AND 5 GROUP BY {keys}),
rows3 AS (SELECT * FROM rows2
  UNION ALL SELECT {keys}, month, revenue, NULL, 'actual' FROM numbered WHERE n < 6
  UNION ALL SELECT {keys}, CAST(month + to_months(CAST(h AS INT)) AS TIMESTAMP),
    greatest(0.0::DOUBLE, (a + b + c) / 3.0::DOUBLE + (c - a) / 3.0::DOUBLE * h), NULL, 'forecast' FROM tails, range(1, 4) t(h))"""


def _recursive(text: str) -> str:
    return text.replace("WITH", "WITH RECURSIVE", 1)


_RFM = f"""
, rbase AS (SELECT tenant_id, customer_id AS customer_key, CAST(sum(total) AS DOUBLE) AS monetary, count(total) AS frequency,
    CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(order_date))) / 86400) AS BIGINT) AS recency FROM sales GROUP BY ALL),
rranks AS (SELECT *, count(*) OVER (PARTITION BY tenant_id) AS n,
    row_number() OVER (PARTITION BY tenant_id ORDER BY recency, customer_key) AS rr,
    row_number() OVER (PARTITION BY tenant_id ORDER BY frequency, customer_key) AS fr,
    row_number() OVER (PARTITION BY tenant_id ORDER BY monetary, customer_key) AS mr FROM rbase),
scores AS (SELECT tenant_id, customer_key, monetary, frequency, recency,
    CAST(6 - greatest(1, ceil((rr - 1) * 5 / (n - 1))) AS INT) AS r_score,
    CAST(greatest(1, ceil((fr - 1) * 5 / (n - 1))) AS INT) AS f_score,
    CAST(greatest(1, ceil((mr - 1) * 5 / (n - 1))) AS INT) AS m_score FROM rranks),
rfm AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
    WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers'
    WHEN r_score >= 3 AND f_score >= 3 AND m_score <= 2 THEN 'Potential Loyalist' WHEN r_score >= 4 AND f_score >= 2 AND m_score >= 2 THEN 'Promising'
    WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'Cannot Lose Them' WHEN r_score <= 2 AND f_score BETWEEN 2 AND 3 THEN 'At Risk'
    WHEN r_score <= 2 AND f_score <= 2 AND m_score >= 3 THEN 'Cannot Lose Them' WHEN r_score <= 3 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating'
    ELSE 'Need Attention' END AS segment FROM scores),
rsum AS (SELECT tenant_id, segment, count(*) AS customers, CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue FROM rfm GROUP BY ALL)"""

_PERCENT = "format('{{:.1f}}', floor({} * 10 + 0.5) / 10)"

_REPEAT = """
, po AS (SELECT tenant_id, customer_id, count(DISTINCT order_id) AS orders FROM sales GROUP BY ALL),
rep AS (SELECT tenant_id, count(*) AS total_customers, count(*) FILTER (WHERE orders > 1) AS customers_with_repeat_orders,
    CAST(sum(orders) AS DOUBLE) AS orders FROM po GROUP BY ALL),
repeat_ready AS (SELECT tenant_id, total_customers, customers_with_repeat_orders,
    floor(customers_with_repeat_orders / total_customers * 100 * 10 + 0.5) / 10 AS repeat_customer_percentage,
    floor(orders / total_customers * 100 + 0.5) / 100 AS avg_orders_per_customer, customers_with_repeat_orders >= 5 AS available,
    CASE WHEN customers_with_repeat_orders >= 5 THEN '✅ EXCELLENT! You have ' || customers_with_repeat_orders || ' customers with multiple orders ('
      || format('{:.1f}', floor(customers_with_repeat_orders / total_customers * 100 * 10 + 0.5) / 10) || '%). Perfect for repeat purchase analysis!'
      ELSE '⚠️ LIMITED: Only ' || customers_with_repeat_orders || ' customers have multiple orders. Analysis possible but insights will be limited.' END AS recommendation
  FROM rep)"""

_BASKET = """
, pb AS (SELECT tenant_id, order_id, count(*) AS n FROM lines GROUP BY ALL),
bas AS (SELECT tenant_id, count(*) AS total_orders, count(*) FILTER (WHERE n > 1) AS orders_with_multiple_products, CAST(sum(n) AS DOUBLE) AS n FROM pb GROUP BY ALL),
basket_ready AS (SELECT tenant_id, total_orders, orders_with_multiple_products,
    floor(orders_with_multiple_products / total_orders * 100 * 10 + 0.5) / 10 AS multi_product_percentage,
    floor(n / total_orders * 100 + 0.5) / 100 AS avg_products_per_order, orders_with_multiple_products >= 10 AS available,
    CASE WHEN orders_with_multiple_products >= 10 THEN '✅ EXCELLENT! You have ' || orders_with_multiple_products || ' orders with multiple products ('
      || format('{:.1f}', floor(orders_with_multiple_products / total_orders * 100 * 10 + 0.5) / 10) || '%). Perfect for basket analysis!'
      ELSE '⚠️ LIMITED: Only ' || orders_with_multiple_products || ' orders have multiple products. Analysis possible but few bundle opportunities will be found.' END AS recommendation
  FROM bas)"""

_COLOURS = """CASE segment WHEN 'Champions' THEN '#22c55e' WHEN 'Loyal Customers' THEN '#3b82f6' WHEN 'Cannot Lose Them' THEN '#dc2626'
  WHEN 'At Risk' THEN '#f97316' WHEN 'Potential Loyalist' THEN '#8b5cf6' WHEN 'New Customers' THEN '#06b6d4' WHEN 'Promising' THEN '#84cc16'
  WHEN 'Need Attention' THEN '#eab308' WHEN 'Hibernating' THEN '#64748b' WHEN 'High Value' THEN '#8b5cf6' WHEN 'Regular' THEN '#10b981'
  WHEN 'Low Value' THEN '#f59e0b' ELSE '#94a3b8' END"""


def _labelled(keys: str, rows: str = "rows2") -> str:
    return f"""SELECT {keys}, strftime(month, '%Y-%m') AS period, strftime(month, '%b %Y') AS display_name, revenue,
  predicted_revenue, type FROM {rows}"""


SQL = {
    "l5_basket_pairs": with_lines("""
, baskets AS (SELECT DISTINCT tenant_id, order_id, product_id FROM lines),
totals AS (SELECT tenant_id, count(DISTINCT order_id) AS n FROM baskets GROUP BY ALL),
items AS (SELECT tenant_id, product_id, count(*) AS orders FROM baskets GROUP BY ALL),
pairs AS (SELECT tenant_id, a.product_id AS item_a, b.product_id AS item_b, count(*) AS orders
  FROM baskets a JOIN baskets b USING (tenant_id, order_id) WHERE a.product_id < b.product_id GROUP BY ALL HAVING count(*) >= 2)
SELECT p.tenant_id, item_a, item_b, p.orders, p.orders / n AS support, p.orders / a.orders AS confidence, p.orders / b.orders AS confidence_back,
  p.orders * n / (a.orders * b.orders) AS lift
FROM pairs p JOIN totals USING (tenant_id) JOIN items a ON a.tenant_id = p.tenant_id AND a.product_id = item_a
JOIN items b ON b.tenant_id = p.tenant_id AND b.product_id = item_b"""),
    "d1_total_revenue": with_orders("SELECT tenant_id, CAST(sum(total) AS DOUBLE) AS total_revenue FROM sales GROUP BY ALL"),
    "d2_active_customers": with_orders("SELECT tenant_id, count(DISTINCT customer_id) AS active_customers FROM sales GROUP BY ALL"),
    "d3_average_order_value": with_lines("""
, o AS (SELECT tenant_id, order_id, sum(total) AS t FROM lines GROUP BY ALL)
SELECT tenant_id, CAST(sum(t) AS DOUBLE) / count(*) AS average_order_value FROM o GROUP BY ALL"""),
    "d4_recency_churn": with_orders(f"""
, l AS (SELECT tenant_id, customer_id, max(order_date) AS last FROM sales GROUP BY ALL)
SELECT tenant_id, CAST(count(*) FILTER (WHERE floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last)) / 86400) > 60) AS DOUBLE) / count(*) * 100
  AS churn_risk_percentage FROM l GROUP BY ALL"""),
    "d8_file_stats": with_lines("""
, fl AS (SELECT *, upload_id || '/' || customer_location AS source_file FROM lines)
SELECT tenant_id, source_file, count(*) AS records, strftime(min(order_date), '%Y-%m-%d') AS start, strftime(max(order_date), '%Y-%m-%d') AS "end",
  CAST(sum(total) AS DOUBLE) AS total_revenue, count(DISTINCT source_file) AS files, 15 AS columns
FROM fl GROUP BY GROUPING SETS ((tenant_id, source_file), (tenant_id))"""),
    "d9_sales_feed_stats": with_lines("""
SELECT tenant_id, count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
  CAST(sum(total) AS DOUBLE) AS total_revenue, CAST(sum(total) AS DOUBLE) / count(total) AS avg_order_value FROM lines GROUP BY ALL"""),
    "d10_product_feed_stats": """
SELECT count(*) AS total_products, count(DISTINCT p_type) AS categories,
  CAST(sum(CAST(p_retailprice AS DECIMAL(18,4))) AS DOUBLE) / count(p_retailprice) AS avg_price,
  min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part""",
    "d11_category_performance": with_lines("""
SELECT tenant_id, category, count(order_id) AS total_orders, CAST(sum(total) AS DOUBLE) AS total_revenue,
  count(DISTINCT customer_id) AS unique_customers FROM lines GROUP BY ALL"""),
    "d12_data_overview": with_lines("""
SELECT tenant_id, count(*) AS total_rows, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT order_id) AS unique_orders,
  count(DISTINCT product_name) AS unique_products, 17 AS columns_available FROM lines GROUP BY ALL"""),
    "d13_repeat_readiness": with_orders(_REPEAT + "SELECT * FROM repeat_ready"),
    "d14_basket_readiness": with_lines(_BASKET + "SELECT * FROM basket_ready"),
    "d15_overall_readiness": with_orders(_REPEAT + _BASKET + """
SELECT tenant_id, CAST(r.available AS BIGINT) + CAST(b.available AS BIGINT) AS features_available_count,
  CASE CAST(r.available AS BIGINT) + CAST(b.available AS BIGINT)
    WHEN 2 THEN '🎉 PERFECT! Your data supports BOTH advanced features. You can unlock deeper customer insights!'
    WHEN 1 THEN '👍 GOOD! Your data supports 1 advanced feature. Some deeper insights available.'
    ELSE '📊 BASIC: Your data supports overview analytics only. Advanced features need more data structure.' END AS overall_recommendation
FROM repeat_ready r JOIN basket_ready b USING (tenant_id)"""),
    "e7_customer_revenue": with_orders(_REVENUE + """
SELECT * REPLACE (strftime(first_order, '%Y-%m-%d') AS first_order, strftime(last_order, '%Y-%m-%d') AS last_order) FROM stats"""),
    "e8_revenue_quartiles": with_orders(_QUARTILES + "SELECT tenant_id, customer_key, revenue_quartile FROM quart"),
    "e9_quartile_summary": with_orders(_QUARTILES + f"""
SELECT tenant_id, revenue_quartile AS segment, {_SUMS} FROM quart WHERE revenue_quartile <> 'All' GROUP BY tenant_id, revenue_quartile
UNION ALL SELECT tenant_id, NULL AS segment, {_SUMS} FROM quart GROUP BY tenant_id"""),
    "e10_top_customers": with_orders(_REVENUE + """
SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY total_revenue DESC, customer_key) AS rank, customer_key, total_revenue,
  total_orders, revenue_per_order, lifetime_days FROM stats QUALIFY rank <= 10"""),
    "e12_monthly_revenue": with_orders(_MONTHS + "SELECT tenant_id, strftime(month, '%Y-%m-%d') AS month, revenue FROM months"),
    "e13_smoothing_forecast": _recursive(with_orders(_MONTHS + smoothed_sql("tenant_id") + _labelled("tenant_id"))),
    "e15_fit_quality": _recursive(with_orders(_MONTHS + smoothed_sql("tenant_id") + """
, v AS (SELECT tenant_id, any_value(level) AS level, any_value(trend) AS trend,
    max(CASE WHEN i = n - 2 THEN revenue END) AS a0, max(CASE WHEN i = n - 1 THEN revenue END) AS a1,
    max(CASE WHEN i = n - 2 THEN predicted END) AS p0, max(CASE WHEN i = n - 1 THEN predicted END) AS p1 FROM back GROUP BY ALL),
w AS (SELECT *, (a0 + a1) / 2.0::DOUBLE AS mean FROM v)
SELECT tenant_id, level, trend, (abs(p0 - a0) + abs(p1 - a1)) / 2.0::DOUBLE AS mae,
  CASE WHEN (a0 - mean) * (a0 - mean) + (a1 - mean) * (a1 - mean) <> 0 THEN 1.0::DOUBLE - ((p0 - a0) * (p0 - a0) + (p1 - a1) * (p1 - a1))
    / ((a0 - mean) * (a0 - mean) + (a1 - mean) * (a1 - mean)) ELSE 0.0 END AS r2 FROM w""")),
    "e16_simple_forecast": with_orders("""
, months AS (SELECT tenant_id, year(order_date) || '-Q' || quarter(order_date) AS quarter, date_trunc('month', order_date) AS month,
               CAST(sum(total) AS DOUBLE) AS revenue FROM sales GROUP BY ALL),
numbered AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, quarter) AS n, row_number() OVER (PARTITION BY tenant_id, quarter ORDER BY month) AS i FROM months),
lasts AS (SELECT tenant_id, quarter, max(month) AS month, max(CASE WHEN i = n - 2 THEN revenue END) AS a, max(CASE WHEN i = n - 1 THEN revenue END) AS b,
          max(CASE WHEN i = n THEN revenue END) AS c FROM numbered WHERE n >= 3 GROUP BY tenant_id, quarter),
rows2 AS (SELECT tenant_id, quarter, month, revenue, CAST(NULL AS DOUBLE) AS predicted_revenue, 'actual' AS type FROM months
  UNION ALL SELECT tenant_id, quarter, CAST(month + to_months(CAST(h AS INT)) AS TIMESTAMP),
    greatest(0.0::DOUBLE, (a + b + c) / 3.0::DOUBLE + (c - a) / 3.0::DOUBLE * h), NULL, 'forecast' FROM lasts, range(1, 4) t(h))
""" + _labelled("tenant_id, quarter")),
    "e18_chart_series": _recursive(with_orders(_MONTHS + smoothed_sql("tenant_id") + """
SELECT tenant_id, strftime(month, '%Y-%m') AS period, strftime(month, '%b %Y') AS month,
  CASE WHEN type <> 'forecast' THEN revenue END AS actual,
  CASE type WHEN 'validation' THEN predicted_revenue WHEN 'forecast' THEN revenue END AS forecast FROM rows2""")),
    "f1_rfm_base": with_orders(_RFM + "SELECT * FROM rbase"),
    "f2_rfm_scores": with_orders(_RFM + "SELECT * FROM scores"),
    "f3_rfm_segments": with_orders(_RFM + "SELECT tenant_id, customer_key, segment FROM rfm"),
    "f4_rfm_summary": with_orders(_RFM + f"""SELECT *, total_revenue / customers AS avg_revenue, {_COLOURS} AS color,
  row_number() OVER (PARTITION BY tenant_id ORDER BY customers DESC, segment) AS position FROM rsum"""),
    "f5_rfm_top_customers": with_orders(_RFM + """
SELECT tenant_id, segment, customer_key, monetary, frequency, recency,
  'R:' || r_score || ', F:' || f_score || ', M:' || m_score AS rfm_scores, s.customers AS segment_customers, s.total_revenue AS segment_revenue,
  row_number() OVER (PARTITION BY tenant_id, segment ORDER BY monetary DESC, customer_key) AS rank
FROM rfm JOIN rsum s USING (tenant_id, segment) QUALIFY rank <= 5"""),
    "f6_rfm_reconciliation": with_orders(_RFM + """
SELECT tenant_id, count(*) AS expected_customers, CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS expected_revenue,
  count(*) AS actual_customers, CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS actual_revenue, TRUE AS reconciled FROM rfm GROUP BY ALL"""),
    "f7_revenue_tiers": with_orders(f"""
, sp AS (SELECT tenant_id, customer_id, CAST(sum(total) AS DOUBLE) AS spend FROM sales GROUP BY ALL),
ed AS (SELECT tenant_id, floor(quantile_cont(spend, 0.2) * 10000 + 0.5) / 10000 AS p20, floor(quantile_cont(spend, 0.8) * 10000 + 0.5) / 10000 AS p80 FROM sp GROUP BY ALL),
ti AS (SELECT tenant_id, spend, CASE WHEN spend >= p80 THEN 'High Value' WHEN spend >= p20 THEN 'Regular' ELSE 'Low Value' END AS segment FROM sp JOIN ed USING (tenant_id)),
su AS (SELECT tenant_id, segment, count(*) AS customers, CAST(sum(CAST(spend AS DECIMAL(38,4))) AS DOUBLE) AS total_revenue FROM ti GROUP BY ALL)
SELECT *, total_revenue / customers AS avg_revenue, {_COLOURS} AS color FROM su"""),
    "f8_segment_descriptions": with_orders(_RFM + """
SELECT tenant_id, segment, CASE segment WHEN 'Champions' THEN 'Best customers - high value, frequent, recent'
  WHEN 'Loyal Customers' THEN 'Consistent customers with good value' WHEN 'Potential Loyalist' THEN 'Recent customers with potential'
  WHEN 'New Customers' THEN 'Recently acquired customers' WHEN 'Promising' THEN 'New customers with good early signs'
  WHEN 'Need Attention' THEN 'Below average customers needing focus' WHEN 'About To Sleep' THEN 'Declining engagement, needs intervention'
  WHEN 'At Risk' THEN 'Haven''t purchased recently, at risk of churning' WHEN 'Cannot Lose Them' THEN 'High-value customers with declining activity'
  WHEN 'Hibernating' THEN 'Inactive customers with low recent activity' ELSE 'Customer segment based on behavior' END AS description FROM rsum"""),
    "l4_location_forecast": _recursive(with_orders("""
, months AS (SELECT tenant_id, customer_location, date_trunc('month', order_date) AS month, CAST(sum(total) AS DOUBLE) AS revenue FROM sales GROUP BY ALL)"""
        + _forecast_sql("tenant_id, customer_location") + _labelled("tenant_id, customer_location", "rows3"))),
}
