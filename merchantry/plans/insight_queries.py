"""Registered queries over portfolio insights, customer lists and action state."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.operators import drilldown as j
from merchantry.operators import growth_plan
from merchantry.operators import insights as i
from merchantry.operators.customers import customer360
from merchantry.operators.dashboard import run_export
from merchantry.operators.segments import weekly_actions
from merchantry.plans.recommendation_queries import TOLD
from merchantry.plans.shared import (
    acted_customers, customers_table, insight_members_table, insights_table, marks_table, members_table, plan_table, orders_table,
)
from merchantry.plans.customer_queries import WEEKLY_ACTIONS
from merchantry.plans.sql_customers import with_customers, with_recommended
from merchantry.session import store
from merchantry.sources.star_schema import UPLOAD, order_heads, sales_orders

REENGAGE = "send-personal-re-engagement-email"


def _groups(s, f):
    return growth_plan.action_groups(plan_table(s, f), UPLOAD)


def _state_log(s, f):
    """A log of done and snoozed clicks, one per order, on the actions of its export."""
    heads = order_heads(s, f)
    key = F.col("o_orderkey")
    action = F.element_at(
        F.array(*[F.lit(a) for a in (
            "send-personal-re-engagement-email", "send-targeted-win-back-sequence", "send-onboarding-email-sequence",
            "send-restock-notification", "test-at-full-price-remove-from-promotion",
        )]),
        (key % 5 + 1).cast("int"),
    )
    snoozed = key % 3 == 0
    return heads.select(
        *UPLOAD,
        action.alias("action_key"),
        (key % 2 == 0).alias("is_done"),
        snoozed.alias("snoozed"),
        F.when(snoozed & (key % 4 != 0), F.when(key % 7 == 0, "1995").otherwise(F.col("upload_id"))).alias("snooze_upload_id"),
        (F.date_format(F.col("order_date").cast("timestamp_ntz"), "yyyy-MM-dd")).alias("_day"),
        key.alias("_key"),
    ).withColumn("updated_at", F.concat_ws("/", "_day", F.lpad(F.col("_key").cast("string"), 12, "0"))).drop("_day", "_key")


def _stated(s, f):
    out = j.apply_action_state(_groups(s, f), _state_log(s, f), F.col("upload_id"), UPLOAD)
    return out.select(*UPLOAD, "action", "action_key", "customer_count", "is_done", "position")


def _fallback_cards(s, f):
    """Cards for the exports without an insight on new customers' order value."""
    quality = insights_table(s, f).where(F.col("insight_id") == "cohort-new-customer-quality")
    return j.fallback_cards(_groups(s, f), quality, UPLOAD)


def _full_run(s, folder):
    """Counts of every table of a whole run, over all merchants with all years as one export."""
    results = run_export(sales_orders(s, folder, product=True).drop("upload_id"), ["tenant_id"])

    def rows(df, name):
        return df.groupBy("tenant_id").agg(F.count("*").alias(name))

    out = rows(results.customers, "customers")
    for df, name in (
        (results.segments, "segments"), (results.plan_members, "planned"), (results.insights, "insights"),
    ):
        out = out.join(rows(df, name), "tenant_id", "left")
    return out.na.fill(0)


def _shares(s, f, *columns):
    """The shares that the concentration rules compare with their thresholds."""
    metrics = i.portfolio_metrics(customers_table(s, f), marks_table(s, f), UPLOAD)
    return metrics.select(*UPLOAD, *columns)


def _concentrated(s, f):
    """Insights over orders of which a few customers bring most revenue, one product and one month most orders."""
    number, order = F.col("customer_id").cast("bigint"), F.col("order_id").cast("bigint")
    orders = orders_table(s, f).withColumns({
        "total": F.when(number % 20 == 0, (F.col("total") * 200).cast("decimal(18,4)")).otherwise(F.col("total")),
        "product_name": F.when(order % 3 != 0, "Anchor").otherwise(F.col("product_name")),
        "order_date": F.when(order % 4 != 0, F.make_timestamp_ntz(F.year("order_date"), F.lit(11), F.lit(5), F.lit(0), F.lit(0), F.lit(0)))
        .otherwise(F.col("order_date")),
    })
    customers = store(customer360(store(orders, "concentrated-orders"), UPLOAD), "concentrated-customers")
    return i.insights(i.portfolio(customers, i.group_marks(customers, UPLOAD), UPLOAD), UPLOAD)


QUERIES = {
    "i13_concentrated_insights": lambda s, f: _concentrated(s, f).drop("explanation", "data_logic", "suggested_action"),
    "i9_customer_concentration": lambda s, f: _shares(s, f, "decile_size", "top_10_pct_revenue_share"),
    "i10_product_concentration": lambda s, f: _shares(s, f, "top_product", "product_values", "top_product_concentration_pct"),
    "i11_seasonality": lambda s, f: _shares(s, f, "top_month", "peak_month_pct"),
    "h19_full_run": _full_run,
    "i13_insights": lambda s, f: insights_table(s, f).drop("explanation", "data_logic", "suggested_action"),
    "i16_insight_texts": lambda s, f: insights_table(s, f).select(
        *UPLOAD, "insight_id", "explanation", "data_logic", "suggested_action"
    ),
    "i14_insight_members": lambda s, f: insight_members_table(s, f).select(*UPLOAD, "insight_id", "customer_key"),
    "i14_listed_members": lambda s, f: i.listed_members(insight_members_table(s, f), RULES.insight_member_rows, UPLOAD),
    "i15_portfolio_triggers": lambda s, f: i.triggered(
        i.portfolio_metrics(customers_table(s, f), marks_table(s, f), UPLOAD), UPLOAD
    ),
    "j1_segment_customers": lambda s, f: j.segment_customers(acted_customers(s, f), "Going Quiet", UPLOAD),
    "j2_action_customers": lambda s, f: j.action_customers(acted_customers(s, f), members_table(s, f), REENGAGE, UPLOAD),
    "j2_action_customers_all": lambda s, f: j.action_customers(
        acted_customers(s, f), members_table(s, f), None, UPLOAD
    ),
    "j3_insight_customers": lambda s, f: j.insight_customers(
        customers_table(s, f), insight_members_table(s, f), "discount-dependency", UPLOAD
    ).select(*UPLOAD, "customer_key", "total_revenue", "segment"),
    "j4_top_customers": lambda s, f: j.top_customers_by_spend(acted_customers(s, f), 10, UPLOAD),
    "j7_open_actions": lambda s, f: j.open_actions(_groups(s, f), "medium"),
    "j7_monitoring_actions": lambda s, f: j.monitoring_actions(weekly_actions(customers_table(s, f), UPLOAD)),
    "j8_action_state": _stated,
    "j10_shown_insights": lambda s, f: j.shown(insights_table(s, f), 3).select(*UPLOAD, "position", "insight_id", "score"),
    "j11_fallback_cards": _fallback_cards,
}

MARKS = """
, sized AS (
  SELECT *, count(*) OVER g AS customers_n, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY total_revenue DESC, customer_key) AS rev_rank
  FROM customers WINDOW g AS (PARTITION BY tenant_id, upload_id)),
prod AS (SELECT tenant_id, upload_id, most_bought_product, count(*) AS cnt, count(*) OVER (PARTITION BY tenant_id, upload_id) AS product_values
         FROM customers GROUP BY tenant_id, upload_id, most_bought_product),
topprod AS (SELECT tenant_id, upload_id, most_bought_product AS top_product, product_values, cnt AS top_product_customers FROM prod
            QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY cnt DESC, most_bought_product) = 1),
mon AS (SELECT tenant_id, upload_id, month(last_order_date) AS m, count(*) AS cnt FROM customers GROUP BY ALL),
topmon AS (SELECT tenant_id, upload_id, m AS top_month, cnt AS top_month_customers FROM mon
           QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY cnt DESC, m) = 1),
marks AS (SELECT tenant_id, upload_id, count(*) AS n_all,
            CAST(sum(CAST(floor(aov * 1000000 + 0.5) / 1000000 AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS mean_aov,
            CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS all_revenue, median(total_revenue) AS median_revenue
          FROM customers GROUP BY ALL),
marked AS (
  SELECT s.*, top_product, product_values, top_product_customers, top_month, top_month_customers, n_all, mean_aov, all_revenue, median_revenue,
         rev_rank <= greatest(1, n_all // 10) AS in_decile
  FROM sized s JOIN marks USING (tenant_id, upload_id) JOIN topprod USING (tenant_id, upload_id) JOIN topmon USING (tenant_id, upload_id)),
listed AS (
  SELECT *, unnest([x FOR x IN [
    CASE WHEN is_lapsed AND is_high_value THEN 'retention-lapsed-high-value' END,
    CASE WHEN is_at_risk AND is_high_value AND NOT is_lapsed THEN 'retention-at-risk-high-value' END,
    CASE WHEN is_lapsed THEN 'retention-overall-lapse-rate' END,
    CASE WHEN is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60 THEN 'growth-first-to-second-window' END,
    CASE WHEN is_full_price_loyal AND is_repeat_customer THEN 'growth-full-price-loyalists' END,
    CASE WHEN is_discount_dependent THEN 'discount-dependency' END,
    CASE WHEN is_new_customer THEN 'cohort-new-customer-quality' END,
    CASE WHEN in_decile THEN 'concentration-top10pct' END,
    CASE WHEN most_bought_product = top_product THEN 'concentration-product' END,
    CASE WHEN month(last_order_date) = top_month THEN 'seasonality-peak-month' END] IF x IS NOT NULL]) AS insight_id
  FROM marked),
sums AS (
  SELECT tenant_id, upload_id, insight_id, count(*) AS n,
    CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS rev,
    CAST(sum(CAST(total_discount_amount AS DECIMAL(38,4))) AS DOUBLE) AS given,
    CAST(sum(CAST(floor(aov * 1000000 + 0.5) / 1000000 AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS group_aov,
    any_value(n_all) AS n_all, any_value(mean_aov) AS mean_aov, any_value(all_revenue) AS all_revenue,
    any_value(top_product) AS top_product, any_value(product_values) AS product_values, any_value(top_month) AS top_month
  FROM listed GROUP BY tenant_id, upload_id, insight_id),
reps AS (SELECT tenant_id, upload_id, count(*) FILTER (WHERE is_repeat_customer) AS repeats, any_value(n_all) AS n_all,
                any_value(all_revenue) AS all_revenue FROM marked GROUP BY ALL),
candidates AS (
  SELECT tenant_id, upload_id, insight_id, n AS affected_count, all_revenue,
    CASE insight_id WHEN 'growth-first-to-second-window' THEN rev * 1.2::DOUBLE WHEN 'discount-dependency' THEN given ELSE rev END AS stake,
    CASE insight_id WHEN 'retention-overall-lapse-rate' THEN n / n_all * 100 > 15 AND n >= 5
      WHEN 'cohort-new-customer-quality' THEN n_all >= 5 AND n >= 3 AND group_aov > mean_aov * 1.1::DOUBLE
      WHEN 'concentration-top10pct' THEN n_all >= 10 AND rev / all_revenue * 100 > 50
      WHEN 'concentration-product' THEN product_values >= 2 AND n / n_all * 100 > 40
      WHEN 'seasonality-peak-month' THEN n_all >= 10 AND n / n_all * 100 > 30 ELSE TRUE END AS fires,
    CASE WHEN insight_id = 'concentration-top10pct' OR n >= 10 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS confidence,
    CASE insight_id
      WHEN 'retention-lapsed-high-value' THEN 'High-value customers have gone cold — ' || n || ' lapsed buyers'
      WHEN 'retention-at-risk-high-value' THEN 'Win-back window open — ' || n || ' valuable buyers overdue'
      WHEN 'retention-overall-lapse-rate' THEN CAST(round_even(n / n_all * 100, 0) AS BIGINT) || '% of your customer base has lapsed — above healthy levels'
      WHEN 'growth-first-to-second-window' THEN 'Conversion window closing — ' || n || ' one-time buyers need a nudge now'
      WHEN 'growth-full-price-loyalists' THEN n || ' full-price loyalists — your highest-margin customers'
      WHEN 'discount-dependency' THEN n || ' customers (' || CAST(round_even(n / n_all * 100, 0) AS BIGINT) || '%) are discount-dependent — margin is leaking'
      WHEN 'cohort-new-customer-quality' THEN 'New customers are spending ' || CAST(round_even((group_aov / mean_aov - 1) * 100, 0) AS BIGINT) || '% more than your average'
      WHEN 'concentration-top10pct' THEN 'Top ' || n || ' customers drive ' || CAST(round_even(rev / all_revenue * 100, 0) AS BIGINT) || '% of your revenue — concentration risk'
      WHEN 'concentration-product' THEN '''' || top_product || ''' is the most-bought item for ' || CAST(round_even(n / n_all * 100, 0) AS BIGINT) || '% of your customers'
      ELSE ['January','February','March','April','May','June','July','August','September','October','November','December'][top_month]
        || ' is your biggest buying month — ' || CAST(round_even(n / n_all * 100, 0) AS BIGINT) || '% of orders land then' END AS headline
  FROM sums
  UNION ALL
  SELECT tenant_id, upload_id, 'cohort-low-repeat-rate', n_all - repeats, all_revenue, 0.0::DOUBLE, n_all >= 5 AND repeats / n_all * 100 < 30,
    CASE WHEN n_all >= 20 THEN 'high' ELSE 'medium' END,
    'Only ' || CAST(round_even(repeats / n_all * 100, 0) AS BIGINT) || '% of customers have bought more than once' FROM reps),
rules(insight_id, rule, category, flag_citations, act) AS (VALUES
  ('retention-lapsed-high-value', 1, 'retention_risk', 'is_lapsed,is_high_value', 1.0),
  ('retention-at-risk-high-value', 2, 'retention_risk', 'is_at_risk,is_high_value', 1.0),
  ('retention-overall-lapse-rate', 3, 'retention_risk', 'is_lapsed', 0.7),
  ('growth-first-to-second-window', 4, 'growth_opportunity', 'is_one_time_buyer,days_since_last_order', 1.0),
  ('growth-full-price-loyalists', 5, 'growth_opportunity', 'is_full_price_loyal,is_repeat_customer', 1.0),
  ('discount-dependency', 6, 'discount_inefficiency', 'is_discount_dependent,discount_usage_rate,total_discount_amount', 0.5),
  ('cohort-low-repeat-rate', 7, 'cohort_quality', 'is_repeat_customer', 0.7),
  ('cohort-new-customer-quality', 8, 'cohort_quality', 'is_new_customer,aov', 1.0),
  ('concentration-top10pct', 9, 'customer_concentration', 'total_revenue,is_high_value', 0.7),
  ('concentration-product', 10, 'product_concentration', 'most_bought_product', 0.7),
  ('seasonality-peak-month', 11, 'seasonality', 'last_order_date', 0.7)),
fired AS (
  SELECT c.* EXCLUDE (stake, fires, all_revenue), category, flag_citations, rule, floor(stake * 100 + 0.5) / 100 AS revenue_at_stake,
    floor(((CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END)::DOUBLE * 40
      + least(stake / greatest(all_revenue, 1.0::DOUBLE), 1.0::DOUBLE) * 40 + act::DOUBLE * 20) * 100 + 0.5) / 100 AS score
  FROM candidates c JOIN rules USING (insight_id) WHERE fires AND all_revenue > 0),
placed AS (SELECT * EXCLUDE (rule), row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY score DESC, rule) AS position FROM fired),
behind AS (SELECT l.* FROM listed l SEMI JOIN fired f ON l.tenant_id = f.tenant_id AND l.upload_id = f.upload_id AND l.insight_id = f.insight_id)"""

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"

_METRICS = MARKS + """
, counted2 AS (
  SELECT tenant_id, upload_id, count(*)::DOUBLE AS n,
    count(*) FILTER (WHERE is_lapsed AND is_high_value) AS lapsed_high_value_count,
    count(*) FILTER (WHERE is_at_risk AND is_high_value AND NOT is_lapsed) AS at_risk_high_value_count,
    count(*) FILTER (WHERE is_lapsed) / n * 100 AS lapsed_pct,
    count(*) FILTER (WHERE segment = 'Going Quiet') / n * 100 AS going_quiet_pct,
    CAST(sum(CASE WHEN in_decile THEN CAST(total_revenue AS DECIMAL(38,4)) ELSE 0 END) AS DOUBLE) / any_value(all_revenue) * 100 AS top_10_pct_revenue_share,
    count(*) FILTER (WHERE is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60) AS one_time_buyer_30_60_count,
    count(*) FILTER (WHERE is_at_risk) AS at_risk_count,
    count(*) FILTER (WHERE is_new_customer) AS new_customer_count,
    count(*) FILTER (WHERE is_discount_dependent) AS discount_dependent_count,
    count(*) FILTER (WHERE is_discount_dependent) / n * 100 AS discount_dependent_pct,
    count(*) FILTER (WHERE is_full_price_loyal AND is_repeat_customer) AS full_price_loyalist_count,
    count(*) FILTER (WHERE segment = 'VIPs') / n * 100 AS vip_pct,
    count(*) FILTER (WHERE order_count >= 4 AND is_full_price_loyal AND is_high_value) AS champion_count,
    any_value(top_product_customers) / n * 100 AS top_product_concentration_pct,
    count(*) FILTER (WHERE distinct_products_purchased = 1) / n * 100 AS single_product_buyer_pct,
    count(*) FILTER (WHERE is_repeat_customer AND aov < mean_aov) AS low_aov_repeat_count,
    count(*) FILTER (WHERE segment = 'Regulars' AND order_count >= 3 AND total_revenue > median_revenue) AS regulars_ready_for_vip_count,
    any_value(top_month_customers) / n * 100 AS peak_month_pct,
    count(*) FILTER (WHERE is_high_return_risk) AS high_return_risk_count,
    count(*) FILTER (WHERE is_new_customer AND is_high_return_risk) AS new_customer_high_return_count,
    count(*) FILTER (WHERE is_repeat_customer) / n * 100 AS repeat_rate_pct,
    count(*) FILTER (WHERE is_one_time_buyer) / n * 100 AS one_time_buyer_pct,
    CASE WHEN count(*) FILTER (WHERE is_new_customer) = 0 THEN 0.0 ELSE
      ((CAST(sum(CASE WHEN is_new_customer THEN CAST(floor(aov * 1000000 + 0.5) / 1000000 AS DECIMAL(38,6)) ELSE 0 END) AS DOUBLE)
        / count(*) FILTER (WHERE is_new_customer)) / any_value(mean_aov) - 1) * 100 END AS new_aov_premium_pct,
    count(*) FILTER (WHERE is_lapsed) AS lapsed_count
  FROM marked GROUP BY tenant_id, upload_id),
long2 AS (UNPIVOT (SELECT * EXCLUDE (n) REPLACE (""" + ", ".join(f"{c}::DOUBLE AS {c}" for c in [
    "lapsed_high_value_count", "at_risk_high_value_count", "one_time_buyer_30_60_count", "at_risk_count", "new_customer_count",
    "discount_dependent_count", "full_price_loyalist_count", "champion_count", "low_aov_repeat_count",
    "regulars_ready_for_vip_count", "high_return_risk_count", "new_customer_high_return_count", "lapsed_count",
]) + """) FROM counted2) ON COLUMNS(* EXCLUDE (tenant_id, upload_id)) INTO NAME metric VALUE value),
portfolio_rules(insight_id, title, category, metric, operator, threshold) AS (VALUES
  ('retention-lapsed-high-value', 'High-value customers have gone cold', 'retention_risk', 'lapsed_high_value_count', 'gte', 1.0),
  ('retention-at-risk-high-value', 'Win-back window open for valuable buyers', 'retention_risk', 'at_risk_high_value_count', 'gte', 1.0),
  ('retention-overall-lapse-rate', 'Lapse rate above healthy levels', 'retention_risk', 'lapsed_pct', 'gt', 15.0),
  ('retention-going-quiet-segment', 'Going Quiet segment is growing', 'retention_risk', 'going_quiet_pct', 'gt', 15.0),
  ('retention-customer-concentration', 'Revenue concentrated in top 10% of customers', 'retention_risk', 'top_10_pct_revenue_share', 'gt', 50.0),
  ('revenue-second-purchase-window', 'One-time buyers in the conversion window', 'revenue_opportunity', 'one_time_buyer_30_60_count', 'gte', 1.0),
  ('revenue-going-quiet-recovery', 'Recoverable revenue in Going Quiet segment', 'revenue_opportunity', 'at_risk_count', 'gte', 5.0),
  ('revenue-new-customer-pipeline', 'Strong new customer acquisition pipeline', 'revenue_opportunity', 'new_customer_count', 'gte', 3.0),
  ('discount-dependency', 'Discount-dependent customers squeezing margin', 'discount_inefficiency', 'discount_dependent_count', 'gte', 1.0),
  ('discount-shopper-overweight', 'Discount Shoppers segment above healthy levels', 'discount_inefficiency', 'discount_dependent_pct', 'gt', 20.0),
  ('loyalty-full-price-loyalists', 'Full-price loyalists are your highest-margin customers', 'loyalty', 'full_price_loyalist_count', 'gte', 1.0),
  ('loyalty-vip-underweight', 'VIP segment below healthy benchmark', 'loyalty', 'vip_pct', 'lt', 5.0),
  ('loyalty-champion-concentration', 'Champion customers driving disproportionate value', 'loyalty', 'champion_count', 'gte', 3.0),
  ('cross-sell-product-concentration', 'Single product dominates customer preferences', 'cross_sell', 'top_product_concentration_pct', 'gt', 40.0),
  ('cross-sell-single-product-buyers', 'Customers buying only one product type', 'cross_sell', 'single_product_buyer_pct', 'gt', 30.0),
  ('upsell-low-aov-repeat-buyers', 'Repeat buyers with below-average order value', 'upsell', 'low_aov_repeat_count', 'gte', 5.0),
  ('upsell-regulars-to-vip', 'Regulars ready for VIP elevation', 'upsell', 'regulars_ready_for_vip_count', 'gte', 5.0),
  ('inventory-seasonal-concentration', 'Purchases concentrated in one season', 'inventory', 'peak_month_pct', 'gt', 30.0),
  ('inventory-anchor-sku-risk', 'Anchor product stock risk', 'inventory', 'top_product_concentration_pct', 'gt', 35.0),
  ('returns-high-portfolio-rate', 'High return rate across customer base', 'returns', 'high_return_risk_count', 'gte', 3.0),
  ('returns-new-customer-quality', 'New customers returning at high rates', 'returns', 'new_customer_high_return_count', 'gte', 2.0),
  ('growth-low-repeat-rate', 'Repeat purchase rate below benchmark', 'customer_growth', 'repeat_rate_pct', 'lt', 30.0),
  ('growth-one-time-buyer-overweight', 'One-Time Buyers dominate the customer base', 'customer_growth', 'one_time_buyer_pct', 'gt', 50.0),
  ('growth-new-customer-quality', 'New customers spending above average', 'customer_growth', 'new_aov_premium_pct', 'gt', 10.0),
  ('growth-lapsed-recovery-pool', 'Large lapsed customer recovery pool', 'customer_growth', 'lapsed_count', 'gte', 10.0))
SELECT tenant_id, upload_id, insight_id, title, category, metric, operator, threshold::DOUBLE AS threshold, value
FROM long2 JOIN portfolio_rules USING (metric)
WHERE (operator = 'gte' AND value >= threshold) OR (operator = 'gt' AND value > threshold) OR (operator = 'lt' AND value < threshold)"""


def _title(column: str) -> str:
    return f"array_to_string([upper(w[1]) || w[2:] FOR w IN string_split({column}, '_')], ' ')"


_GROUPS = f"""
, groups2 AS (
  SELECT tenant_id, upload_id, action, {_SLUG.format('action')} AS action_key, priority AS action_priority, customer_count,
    estimated_commercial_value AS total_revenue_at_stake, {_title('channel_code')} AS suggested_channel, {_title('timing_code')} AS suggested_timing,
    row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
                       customer_count DESC, section_position, catalogue_position) AS position
  FROM actions)"""

LISTED_ACTIONS = f"""
, planned AS (SELECT DISTINCT tenant_id, upload_id, customer_key, {_SLUG.format('title')} AS action_key FROM best),
named AS (SELECT *, {_SLUG.format('recommended_action')} AS action_key FROM acted),
chosen AS (
  SELECT a.*, p.action_key FROM acted a JOIN planned p USING (tenant_id, upload_id, customer_key)
  UNION ALL BY NAME
  SELECT * FROM named n WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.tenant_id = n.tenant_id AND p.upload_id = n.upload_id
                                          AND p.action_key = n.action_key))"""

TOLD_ACTIONS = TOLD + LISTED_ACTIONS.replace("FROM acted", "FROM told")

_LIST_COLUMNS = """tenant_id, upload_id, action_key, customer_key AS email_or_id, total_revenue, order_count,
  strftime(last_order_date, '%d %b %Y') AS last_order_date, suggested_channel AS channel, suggested_timing AS timing"""

_WHOLE = with_recommended(MARKS + """
, c AS (SELECT tenant_id, count(*) AS customers, count(DISTINCT segment) AS segments FROM customers GROUP BY ALL),
p AS (SELECT tenant_id, count(*) AS planned FROM best GROUP BY ALL),
i AS (SELECT tenant_id, count(*) AS insights FROM placed GROUP BY ALL)
SELECT tenant_id, customers, segments, coalesce(planned, 0) AS planned, coalesce(insights, 0) AS insights
FROM c LEFT JOIN p USING (tenant_id) LEFT JOIN i USING (tenant_id)""").replace("strftime(o_orderdate, '%Y') AS upload_id", "'all' AS upload_id")

SQL = {
    "i9_customer_concentration": with_customers(MARKS + """
SELECT tenant_id, upload_id, count(*) FILTER (WHERE in_decile) AS decile_size,
  CAST(sum(CASE WHEN in_decile THEN CAST(total_revenue AS DECIMAL(38,4)) ELSE 0 END) AS DOUBLE) / any_value(all_revenue) * 100 AS top_10_pct_revenue_share
FROM marked GROUP BY tenant_id, upload_id"""),
    "i10_product_concentration": with_customers(MARKS + """
SELECT DISTINCT tenant_id, upload_id, top_product, product_values, top_product_customers / n_all * 100 AS top_product_concentration_pct FROM marked"""),
    "i11_seasonality": with_customers(MARKS + """
SELECT DISTINCT tenant_id, upload_id, top_month, top_month_customers / n_all * 100 AS peak_month_pct FROM marked"""),
    "h19_full_run": _WHOLE,
    "i13_insights": with_customers(MARKS + "SELECT * FROM placed"),
    "i14_insight_members": with_customers(MARKS + "SELECT tenant_id, upload_id, insight_id, customer_key FROM behind"),
    "i14_listed_members": with_customers(MARKS + """
SELECT tenant_id, upload_id, insight_id, customer_key, row_number() OVER (PARTITION BY tenant_id, upload_id, insight_id
  ORDER BY CASE WHEN insight_id = 'concentration-top10pct' THEN -total_revenue ELSE 0.0 END, customer_key) AS rank
FROM behind QUALIFY rank <= 200"""),
    "i15_portfolio_triggers": with_customers(_METRICS),
    "j1_segment_customers": with_recommended(TOLD + """
SELECT tenant_id, upload_id, customer_key AS email_or_id, segment, total_revenue, order_count,
  row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY total_revenue DESC, customer_key) AS position,
  strftime(last_order_date, '%d %b %Y') AS last_order_date, days_since_last_order, floor(aov * 100 + 0.5) / 100 AS aov,
  recommended_action, action_reason, action_priority FROM told WHERE segment = 'Going Quiet'"""),
    "j2_action_customers": with_recommended(TOLD_ACTIONS + f"SELECT {_LIST_COLUMNS}, action_reason AS reason FROM chosen WHERE action_key = '{REENGAGE}'"),
    "j2_action_customers_all": with_recommended(TOLD_ACTIONS + f"SELECT {_LIST_COLUMNS}, action_reason AS reason FROM chosen"),
    "j3_insight_customers": with_customers(
        "SELECT tenant_id, upload_id, customer_key, total_revenue, segment FROM customers WHERE is_discount_dependent"
    ),
    "j4_top_customers": with_recommended("""
SELECT tenant_id, upload_id, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY total_revenue DESC, customer_key) AS rank,
  customer_key AS email_or_id, total_revenue, order_count, strftime(last_order_date, '%d %b %Y') AS last_order_date,
  days_since_last_order, aov, recommended_action, action_priority FROM acted QUALIFY rank <= 10"""),
    "j7_open_actions": with_recommended(
        _GROUPS + "SELECT * FROM groups2 WHERE NOT contains(lower(action), 'monitor') AND action_priority = 'medium'"
    ),
    "j7_monitoring_actions": with_customers(WEEKLY_ACTIONS + " QUALIFY contains(lower(action), 'monitor')"),
    "j8_action_state": with_recommended(_GROUPS + """
, log AS (SELECT tenant_id, upload_id, o_orderkey AS k, order_date,
    ['send-personal-re-engagement-email', 'send-targeted-win-back-sequence', 'send-onboarding-email-sequence',
     'send-restock-notification', 'test-at-full-price-remove-from-promotion'][o_orderkey % 5 + 1] AS action_key FROM heads),
latest AS (SELECT tenant_id, upload_id, action_key, k FROM log
           QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, action_key ORDER BY order_date DESC, k DESC) = 1)
SELECT tenant_id, upload_id, action, action_key, customer_count, position, coalesce(k % 2 = 0, FALSE) AS is_done
FROM groups2 LEFT JOIN latest USING (tenant_id, upload_id, action_key)
WHERE NOT coalesce(k % 3 = 0 AND (k % 4 = 0 OR CASE WHEN k % 7 = 0 THEN '1995' ELSE upload_id END = upload_id), FALSE)"""),
    "j10_shown_insights": with_customers(
        MARKS + "SELECT tenant_id, upload_id, position, insight_id, score FROM placed WHERE position <= 3"
    ),
    "j11_fallback_cards": with_recommended(_GROUPS + MARKS + """
SELECT tenant_id, upload_id, 'fallback-' || (position - 1) AS insight_id,
  CASE WHEN contains(lower(action), 'lapsed') OR contains(lower(action), 'win back') OR contains(lower(action), 're-engage') THEN 'retention_risk'
       WHEN contains(lower(action), 'new') OR contains(lower(action), 'convert') OR contains(lower(action), 'second') THEN 'growth_opportunity'
       WHEN contains(lower(action), 'discount') THEN 'discount_inefficiency' ELSE 'growth_opportunity' END AS category,
  action AS headline,
  customer_count || CASE WHEN customer_count = 1 THEN ' customer needs' ELSE ' customers need' END || ' this action. Best channel: '
    || suggested_channel || '. Timing: ' || suggested_timing || '.' AS explanation,
  total_revenue_at_stake AS revenue_at_stake, customer_count AS affected_count, action_priority AS confidence,
  action || ' via ' || suggested_channel || '. ' || suggested_timing || '.' AS suggested_action,
  CASE action_priority WHEN 'high' THEN 80.0 WHEN 'medium' THEN 50.0 ELSE 20.0 END::DOUBLE AS score
FROM groups2 ANTI JOIN (SELECT * FROM placed WHERE insight_id = 'cohort-new-customer-quality') q USING (tenant_id, upload_id)"""),
}

_CONCENTRATED = """sales AS (SELECT * EXCLUDE (line_rank) REPLACE (
  CASE WHEN CAST(customer_id AS BIGINT) % 20 = 0 THEN CAST(total * 200 AS DECIMAL(18,4)) ELSE total END AS total,
  CASE WHEN CAST(order_id AS BIGINT) % 3 <> 0 THEN 'Anchor' ELSE product_name END AS product_name,
  CASE WHEN CAST(order_id AS BIGINT) % 4 <> 0 THEN make_timestamp(year(order_date), 11, 5, 0, 0, 0.0) ELSE order_date END AS order_date)
  FROM lines WHERE line_rank = 1)"""
SQL["i13_concentrated_insights"] = SQL["i13_insights"].replace(
    "sales AS (SELECT * EXCLUDE (line_rank) FROM lines WHERE line_rank = 1)", _CONCENTRATED)
