"""Check SQL for the customer table and the recommendations built on it."""

from merchantry.plans.sql_tables import ORDERS

CUSTOMERS = ORDERS + """,
totals AS (
  SELECT tenant_id, upload_id, customer_id AS customer_key, CAST(sum(total) AS DOUBLE) AS total_revenue,
         count(DISTINCT order_id) AS order_count, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
         sum(quantity) AS total_quantity_purchased, CAST(sum(discount_amount) AS DOUBLE) AS total_discount_amount,
         count(*) FILTER (WHERE discount_amount > 0) AS disc_rows, CAST(sum(refund_amount) AS DOUBLE) AS refund_total,
         CAST(sum(total) - sum(refund_amount) AS DOUBLE) AS net_revenue,
         count(DISTINCT product_name) AS distinct_products_purchased
  FROM sales GROUP BY ALL),
times AS (SELECT DISTINCT tenant_id, upload_id, customer_id AS customer_key, order_date FROM sales),
steps AS (
  SELECT *, floor((epoch(order_date) - epoch(lag(order_date) OVER (
           PARTITION BY tenant_id, upload_id, customer_key ORDER BY order_date))) / 86400) AS gap FROM times),
gaps AS (SELECT tenant_id, upload_id, customer_key, sum(gap) / count(gap) AS avg_gap FROM steps GROUP BY ALL),
firsts AS (
  SELECT tenant_id, upload_id, customer_id AS customer_key, product_name AS first_product_purchased FROM sales
  QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, customer_id ORDER BY order_date, product_name) = 1),
counted AS (
  SELECT tenant_id, upload_id, customer_id AS customer_key, product_name, count(*) AS cnt FROM sales GROUP BY ALL),
mosts AS (
  SELECT tenant_id, upload_id, customer_key, product_name AS most_bought_product FROM counted
  QUALIFY row_number() OVER (PARTITION BY tenant_id, upload_id, customer_key ORDER BY cnt DESC, product_name) = 1),
figures AS (
  SELECT tenant_id, upload_id, date_trunc('day', max(last_order_date)) AS reference_date,
         CASE WHEN count(*) < 5 THEN 0.0
              ELSE floor(quantile_cont(total_revenue, 0.8) * 10000 + 0.5) / 10000 END AS high_value_from
  FROM totals GROUP BY ALL),
derived AS (
  SELECT t.* EXCLUDE (disc_rows), first_product_purchased, most_bought_product, reference_date, high_value_from,
         coalesce(avg_gap, -1.0) AS avg_days_between_orders, total_revenue / order_count AS aov,
         CAST(floor((epoch(reference_date) - epoch(last_order_date)) / 86400) AS BIGINT) AS days_since_last_order,
         CAST(floor((epoch(last_order_date) - epoch(first_order_date)) / 86400) AS BIGINT) AS customer_lifetime_days,
         disc_rows / order_count AS discount_usage_rate
  FROM totals t JOIN figures USING (tenant_id, upload_id)
  LEFT JOIN gaps USING (tenant_id, upload_id, customer_key)
  LEFT JOIN firsts USING (tenant_id, upload_id, customer_key)
  LEFT JOIN mosts USING (tenant_id, upload_id, customer_key)),
flagged AS (
  SELECT *, order_count / (greatest(customer_lifetime_days, 1) / 30.0) AS purchase_frequency,
         order_count >= 2 AS is_repeat_customer, order_count = 1 AS is_one_time_buyer,
         days_since_last_order >= 180 AS is_lapsed, discount_usage_rate > 0.70 AS is_discount_dependent,
         order_count >= 2 AND discount_usage_rate = 0 AS is_full_price_loyal,
         total_revenue >= high_value_from AS is_high_value,
         days_since_last_order BETWEEN 0 AND 30 AS is_new_customer,
         order_count >= 2 AND avg_days_between_orders > 0 AND days_since_last_order >= 0
           AND days_since_last_order > 2 * avg_days_between_orders AS is_at_risk,
         CASE WHEN total_revenue = 0 THEN FALSE ELSE refund_total / total_revenue > 0.30 END AS is_high_return_risk
  FROM derived),
staged AS (
  SELECT *, CASE WHEN is_lapsed THEN 'Lapsed' WHEN is_high_value AND is_full_price_loyal THEN 'VIPs'
                 WHEN is_at_risk THEN 'Going Quiet' WHEN is_new_customer THEN 'New Customers'
                 WHEN is_one_time_buyer THEN 'One-Time Buyers' WHEN is_discount_dependent THEN 'Discount Shoppers'
                 ELSE 'Regulars' END AS segment
  FROM flagged),
ruled AS (
  SELECT *, CASE WHEN is_lapsed AND is_high_value THEN 1 WHEN is_at_risk AND is_high_value THEN 2
                 WHEN is_full_price_loyal THEN 3 WHEN is_new_customer THEN 4
                 WHEN is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60 THEN 5
                 WHEN is_discount_dependent THEN 6 ELSE 7 END AS act
  FROM staged),
customers AS (
  SELECT * EXCLUDE (act, high_value_from),
    ['Personal re-engagement — call, don''t email', 'Send win-back email — offer genuine incentive',
     'Add to VIP audience — no discount needed', 'Send onboarding sequence', 'Send second-purchase nudge',
     'Test at full price — may buy anyway', 'Monitor — no immediate action'][act] AS recommended_action,
    ['No purchase in ' || days_since_last_order || ' days and in top 20% by revenue. High-value lapsed customers need a personal touch.',
     'Last order ' || days_since_last_order || ' days ago — more than 2× their usual gap. High value. Act before they lapse.',
     order_count || ' orders at full price, zero discounts used. Protect margin — keep them off discount lists.',
     'First purchase ' || days_since_last_order || ' days ago. Early nurture is critical for long-term retention.',
     'One purchase ' || days_since_last_order || ' days ago — the 30–60 day window is the best time to convert to repeat buyer.',
     CAST(round_even(discount_usage_rate * 100, 0) AS BIGINT) || '% of orders used a discount. Worth testing removal — they may buy regardless.',
     'No strong behavioural signal. Keep in regular communications.'][act] AS action_reason,
    ['high', 'high', 'medium', 'medium', 'medium', 'low', 'low'][act] AS action_priority,
    ['Personal outreach', 'Email', 'Email / Ads', 'Email', 'Email', 'Email / Ads', 'Regular comms'][act] AS suggested_channel,
    ['Immediately', 'This week', 'This month', 'This week', 'This week', 'Next campaign', 'Ongoing'][act] AS suggested_timing
  FROM ruled)"""

# Recommendation catalogue: position, id, title, category, priority and timing
# score, impact score and base, value, trigger count, channel, timing, priority.
RECOMMENDED = CUSTOMERS + """,
catalogue(position, recommendation_id, title, category, priority, timing, channel, impact_type, impact_value, triggers) AS (VALUES
  (1, 'rec-lapsed-hv-reengagement', 'Send personal re-engagement email', 'protect_revenue', 'high', 'immediately', 'email', 'revenue_at_risk', 150.0, 2),
  (2, 'rec-at-risk-win-back', 'Send win-back email with genuine incentive', 'protect_revenue', 'high', 'this_week', 'email', 'revenue_at_risk', 120.0, 3),
  (3, 'rec-going-quiet-reengagement', 'Send personal re-engagement email', 'protect_revenue', 'medium', 'this_week', 'email', 'revenue_at_risk', 80.0, 3),
  (4, 'rec-lapsed-win-back-sequence', 'Send targeted win-back sequence', 'protect_revenue', 'medium', 'this_month', 'email', 'revenue_at_risk', 60.0, 2),
  (5, 'rec-sms-at-risk-nudge', 'Send SMS win-back nudge', 'protect_revenue', 'high', 'this_week', 'sms', 'revenue_at_risk', 100.0, 2),
  (6, 'rec-onboarding-sequence', 'Send onboarding email sequence', 'grow_revenue', 'medium', 'this_week', 'email', 'revenue_opportunity', 45.0, 1),
  (7, 'rec-second-purchase-nudge', 'Send second-purchase nudge', 'grow_revenue', 'medium', 'this_week', 'email', 'revenue_opportunity', 55.0, 3),
  (8, 'rec-product-recommendation', 'Send personalised product recommendation', 'grow_revenue', 'medium', 'this_month', 'product_recommendation', 'revenue_opportunity', 40.0, 2),
  (9, 'rec-cross-sell-complementary', 'Cross-sell complementary items', 'grow_revenue', 'medium', 'this_month', 'email', 'revenue_opportunity', 35.0, 2),
  (10, 'rec-free-shipping-second-purchase', 'Offer free shipping on second purchase', 'grow_revenue', 'medium', 'this_week', 'free_shipping', 'revenue_opportunity', 30.0, 3),
  (11, 'rec-meta-ads-retarget', 'Retarget with Meta Ads', 'grow_revenue', 'medium', 'this_month', 'meta_ads', 'revenue_opportunity', 50.0, 1),
  (12, 'rec-tiktok-ads-lookalike', 'Acquire lookalikes via TikTok Ads', 'grow_revenue', 'low', 'next_campaign', 'tiktok_ads', 'revenue_opportunity', 25.0, 2),
  (13, 'rec-restock-notification', 'Send restock notification', 'grow_revenue', 'medium', 'this_week', 'restock_notification', 'revenue_opportunity', 45.0, 2),
  (14, 'rec-test-full-price', 'Test at full price — remove from promotion', 'improve_margin', 'low', 'next_campaign', 'email', 'margin_improvement', 20.0, 1),
  (15, 'rec-exclude-from-discount-campaigns', 'Tag and exclude from discount campaigns', 'improve_margin', 'medium', 'immediately', 'shopify_tags', 'margin_improvement', 35.0, 2),
  (16, 'rec-reduce-discount-frequency', 'Reduce discount frequency for dependent buyers', 'improve_margin', 'low', 'next_campaign', 'email', 'margin_improvement', 15.0, 2),
  (17, 'rec-vip-audience', 'Add to VIP audience — no discount needed', 'strengthen_loyalty', 'medium', 'this_month', 'email', 'loyalty_strengthening', 50.0, 2),
  (18, 'rec-vip-early-access', 'Grant early access to new collection', 'strengthen_loyalty', 'medium', 'this_month', 'early_access', 'loyalty_strengthening', 60.0, 2),
  (19, 'rec-loyalty-programme-reward', 'Reward via loyalty programme', 'strengthen_loyalty', 'medium', 'this_month', 'loyalty_programme', 'loyalty_strengthening', 40.0, 2),
  (20, 'rec-free-gift-champion', 'Send free gift to champion customer', 'strengthen_loyalty', 'medium', 'this_month', 'free_gift', 'loyalty_strengthening', 55.0, 3),
  (21, 'rec-instagram-engagement', 'Engage on Instagram', 'strengthen_loyalty', 'low', 'ongoing', 'instagram', 'loyalty_strengthening', 15.0, 1),
  (22, 'rec-monitor-ongoing', 'Monitor — maintain regular communications', 'strengthen_loyalty', 'low', 'ongoing', 'email', 'loyalty_strengthening', 5.0, 6)),
priced_catalogue AS (
  SELECT *, CASE priority WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.65 ELSE 0.35 END::DOUBLE AS priority_score,
    CASE timing WHEN 'immediately' THEN 1.0 WHEN 'this_week' THEN 0.90 WHEN 'this_month' THEN 0.70
                WHEN 'next_campaign' THEN 0.50 ELSE 0.25 END::DOUBLE AS timing_score,
    CASE impact_type WHEN 'revenue_at_risk' THEN 1.0 WHEN 'revenue_opportunity' THEN 0.85
                     WHEN 'margin_improvement' THEN 0.70 ELSE 0.60 END::DOUBLE AS impact_score,
    CASE impact_type WHEN 'revenue_at_risk' THEN 90.0 WHEN 'revenue_opportunity' THEN 75.0
                     WHEN 'margin_improvement' THEN 60.0 ELSE 55.0 END::DOUBLE AS impact_base
  FROM catalogue),
profiles AS (
  SELECT * REPLACE (
      CASE WHEN days_since_last_order = 0 THEN -1 ELSE days_since_last_order END AS days_since_last_order,
      CASE WHEN avg_days_between_orders = 0 THEN -1.0 ELSE avg_days_between_orders END AS avg_days_between_orders,
      CASE WHEN net_revenue = 0 THEN total_revenue ELSE net_revenue END AS net_revenue),
    CASE segment WHEN 'VIPs' THEN 'vip' WHEN 'Regulars' THEN 'regular' WHEN 'New Customers' THEN 'new'
      WHEN 'One-Time Buyers' THEN 'one_time_buyer' WHEN 'Going Quiet' THEN 'going_quiet' WHEN 'Lapsed' THEN 'lapsed'
      ELSE 'discount_shopper' END AS stage,
    CASE WHEN total_revenue > 0 THEN refund_total / total_revenue ELSE 0.0 END AS return_rate
  FROM customers),
hits AS (
  SELECT *, unnest([x FOR x IN [
    CASE WHEN stage IN ('lapsed','vip') AND is_lapsed AND is_high_value THEN 1 END,
    CASE WHEN stage IN ('going_quiet','vip') AND is_at_risk AND is_high_value AND NOT is_lapsed THEN 2 END,
    CASE WHEN stage = 'going_quiet' AND is_at_risk AND is_repeat_customer AND NOT is_high_value THEN 3 END,
    CASE WHEN stage = 'lapsed' AND is_lapsed AND NOT is_high_value THEN 4 END,
    CASE WHEN stage IN ('going_quiet','vip') AND is_at_risk AND is_high_value THEN 5 END,
    CASE WHEN stage = 'new' AND is_new_customer THEN 6 END,
    CASE WHEN stage = 'one_time_buyer' AND is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60 THEN 7 END,
    CASE WHEN stage IN ('regular','vip') AND is_repeat_customer AND most_bought_product IS NOT NULL THEN 8 END,
    CASE WHEN stage IN ('regular','vip','one_time_buyer') AND most_bought_product IS NOT NULL
              AND distinct_products_purchased = 1 THEN 9 END,
    CASE WHEN stage = 'one_time_buyer' AND is_one_time_buyer AND days_since_last_order BETWEEN 21 AND 45 THEN 10 END,
    CASE WHEN stage IN ('going_quiet','one_time_buyer') AND is_at_risk THEN 11 END,
    CASE WHEN stage = 'new' AND is_new_customer AND aov > 0 THEN 12 END,
    CASE WHEN stage IN ('regular','vip') AND most_bought_product IS NOT NULL AND is_repeat_customer THEN 13 END,
    CASE WHEN stage = 'discount_shopper' AND is_discount_dependent THEN 14 END,
    CASE WHEN stage IN ('vip','regular') AND is_full_price_loyal AND is_repeat_customer THEN 15 END,
    CASE WHEN stage = 'discount_shopper' AND is_discount_dependent AND discount_usage_rate > 0.85 THEN 16 END,
    CASE WHEN stage = 'vip' AND is_full_price_loyal AND is_repeat_customer THEN 17 END,
    CASE WHEN stage = 'vip' AND is_full_price_loyal AND is_high_value THEN 18 END,
    CASE WHEN stage IN ('vip','regular') AND is_repeat_customer AND order_count >= 3 THEN 19 END,
    CASE WHEN stage = 'vip' AND is_high_value AND is_full_price_loyal AND order_count >= 4 THEN 20 END,
    CASE WHEN stage IN ('new','vip') AND is_new_customer THEN 21 END,
    CASE WHEN NOT is_lapsed AND NOT is_at_risk AND NOT is_new_customer AND NOT is_one_time_buyer
              AND NOT is_discount_dependent AND NOT is_full_price_loyal THEN 22 END
  ] IF x IS NOT NULL]) AS position
  FROM profiles),
signals AS (
  SELECT h.*, c.* EXCLUDE (position),
    CASE WHEN is_lapsed THEN 1.0 WHEN is_at_risk THEN 0.90 WHEN is_new_customer THEN 0.70
         WHEN is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60 THEN 0.75
         WHEN is_one_time_buyer THEN 0.55 ELSE 0.35 END::DOUBLE AS signal,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, total_revenue / 1000.0::DOUBLE)) AS revenue_share,
    CAST(is_lapsed AS INT) + CAST(is_at_risk AS INT) + CAST(is_full_price_loyal AS INT)
      + CAST(is_discount_dependent AS INT) + CAST(is_high_value AS INT) AS strong
  FROM hits h JOIN priced_catalogue c USING (position)),
parts AS (
  SELECT *,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE * priority_score + 0.30::DOUBLE * timing_score + 0.25::DOUBLE * signal)) AS u,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.40::DOUBLE * impact_score
      + 0.30::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, impact_value::DOUBLE / 500.0::DOUBLE)) + 0.30::DOUBLE * revenue_share)) AS b,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE
      + (CASE WHEN triggers >= 3 THEN 0.10 WHEN triggers = 2 THEN 0.05 ELSE 0.0 END)::DOUBLE
      + (CASE WHEN order_count >= 5 THEN 0.15 WHEN order_count >= 2 THEN 0.10 ELSE 0.0 END)::DOUBLE
      + least(strong * 0.04::DOUBLE, 0.20::DOUBLE)
      + (CASE WHEN days_since_last_order >= 0 THEN 0.05 ELSE 0.0 END)::DOUBLE)) AS c,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.50::DOUBLE * revenue_share
      + 0.15::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, aov / 150.0::DOUBLE))
      + (CASE WHEN is_high_value THEN 0.25 ELSE 0.0 END)::DOUBLE + (CASE WHEN is_repeat_customer THEN 0.10 ELSE 0.0 END)::DOUBLE)) AS v
  FROM signals),
rounded AS (
  SELECT *, floor(u * 10000 + 0.5) / 10000 AS urgency, floor(b * 10000 + 0.5) / 10000 AS business_impact,
    floor(c * 10000 + 0.5) / 10000 AS confidence, floor(v * 10000 + 0.5) / 10000 AS customer_value,
    floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      0.30::DOUBLE * u + 0.30::DOUBLE * b + 0.20::DOUBLE * c + 0.20::DOUBLE * v)) * 10000 + 0.5) / 10000 AS total_score
  FROM parts),
opportunities AS (
  SELECT *, 0.25::DOUBLE * least(least(total_revenue / 1000.0::DOUBLE, 1.0::DOUBLE) * 70 + least(aov / 150.0::DOUBLE, 1.0::DOUBLE) * 15
              + (CASE WHEN is_high_value THEN 15.0 ELSE 0.0 END)::DOUBLE, 100.0::DOUBLE)
    + 0.30::DOUBLE * least(greatest(urgency * 100, (CASE WHEN is_lapsed THEN 85.0 WHEN is_at_risk THEN 75.0
              WHEN is_new_customer THEN 60.0 ELSE 0.0 END)::DOUBLE), 100.0::DOUBLE)
    + 0.25::DOUBLE * (CASE category
        WHEN 'protect_revenue' THEN CASE WHEN is_at_risk AND NOT is_lapsed THEN 65.0 WHEN is_lapsed AND is_high_value THEN 35.0
                                         WHEN is_lapsed THEN 20.0 ELSE 40.0 END
        WHEN 'grow_revenue' THEN CASE WHEN is_one_time_buyer AND days_since_last_order BETWEEN 30 AND 60 THEN 55.0
                                      WHEN is_new_customer THEN 50.0 WHEN is_repeat_customer THEN 45.0 ELSE 30.0 END
        WHEN 'improve_margin' THEN CASE WHEN is_discount_dependent THEN CASE WHEN discount_usage_rate > 0.85 THEN 25.0 ELSE 40.0 END
                                        WHEN is_full_price_loyal THEN 80.0 ELSE 35.0 END
        ELSE CASE WHEN is_full_price_loyal AND is_high_value THEN 75.0 WHEN is_repeat_customer THEN 60.0 ELSE 30.0 END END)::DOUBLE
    + 0.20::DOUBLE * least(impact_base * 0.6::DOUBLE + least(impact_value::DOUBLE / 500.0::DOUBLE, 1.0::DOUBLE) * 20
              + least(total_revenue / 1000.0::DOUBLE, 1.0::DOUBLE) * 20, 100.0::DOUBLE) AS weighted
  FROM rounded),
ranked AS (
  SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, weighted)) * 10 + 0.5) / 10 AS opportunity_score,
    row_number() OVER (PARTITION BY tenant_id, upload_id, customer_key
                       ORDER BY total_score DESC, priority_score DESC, position) AS rank
  FROM opportunities),
best AS (
  SELECT *, CASE category WHEN 'protect_revenue' THEN total_revenue WHEN 'grow_revenue' THEN CASE WHEN aov > 0 THEN aov ELSE total_revenue * 0.5::DOUBLE END
      WHEN 'improve_margin' THEN CASE WHEN total_discount_amount > 0 THEN total_discount_amount ELSE total_revenue * 0.1::DOUBLE END
      ELSE total_revenue * 0.15::DOUBLE END AS commercial_value
  FROM ranked WHERE rank = 1),
actions AS (
  SELECT tenant_id, upload_id, category, recommendation_id, title AS action, priority, position AS catalogue_position,
    channel AS channel_code, timing AS timing_code, count(*) AS customer_count,
    floor(CAST(sum(CAST(floor(commercial_value * 1000000 + 0.5) / 1000000 AS DECIMAL(38,6))) AS DOUBLE) * 100 + 0.5) / 100 AS estimated_commercial_value,
    list_position(['protect_revenue', 'grow_revenue', 'improve_margin', 'strengthen_loyalty'], category) AS section_position,
    ['Protect Revenue', 'Grow Revenue', 'Improve Margin', 'Strengthen Loyalty'][section_position] AS section
  FROM best GROUP BY ALL),
acted AS (
  SELECT c.* REPLACE (coalesce(b.title, c.recommended_action) AS recommended_action,
                      coalesce(b.priority, c.action_priority) AS action_priority,
                      coalesce(array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(b.channel, '_')], ' '), c.suggested_channel) AS suggested_channel,
                      coalesce(array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(b.timing, '_')], ' '), c.suggested_timing) AS suggested_timing)
  FROM customers c LEFT JOIN (SELECT tenant_id, upload_id, customer_key, title, priority, channel, timing FROM best) b
    USING (tenant_id, upload_id, customer_key))"""


def with_customers(body: str) -> str:
    return f"WITH {CUSTOMERS}\n{body}"


def with_recommended(body: str) -> str:
    return f"WITH {RECOMMENDED}\n{body}"
