"""Registered queries over recommendations and the weekly growth plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.operators import growth_plan as p
from merchantry.operators import recommendations as r
from merchantry.operators.catalogue import OUTCOME_TEXT, RECOMMENDATIONS, WHY_TEXT
from merchantry.plans.shared import acted_customers, best_actions_table, customers_table, members_table, plan_table
from merchantry.plans.sql_customers import with_recommended
from merchantry.sources.star_schema import UPLOAD

KEYS = [*UPLOAD, "customer_key"]


def _ranked(s, f):
    return r.ranked(best_actions_table(s, f), KEYS)


def _explained(s, f):
    texts = ["why_selected", "supporting_behaviour", "commercial_importance", "expected_outcome"]
    return best_actions_table(s, f).where(F.col("recommendation_id").isNotNull()).select(*KEYS, "recommendation_id", *texts)


def _nested(s, f):
    plan = p.nested_plan(plan_table(s, f), UPLOAD)
    return plan.select(
        *UPLOAD, "total_customers", "total_commercial_value", F.size("sections").alias("section_count"),
        F.array_join(F.transform("sections", lambda x: x["section"]), ",").alias("section_names"),
        F.aggregate("sections", F.lit(0), lambda n, x: n + F.size(x["actions"])).alias("action_count"),
    )


def _entries_by_stage(s, f):
    """How many catalogue entries the customers of each stage can get."""
    entries = r.catalogue_table(s).select(F.explode("stages").alias("lifecycle_stage")).groupBy("lifecycle_stage").agg(
        F.count("*").alias("entries")
    )
    stages = r.profiles(customers_table(s, f)).groupBy(*UPLOAD, "lifecycle_stage").agg(F.count("*").alias("customers"))
    return stages.join(F.broadcast(entries), "lifecycle_stage")


def _triggers():
    """The catalogue's distinct triggers in a fixed order."""
    found = {(t.attribute, t.op, str(t.value)): t for entry in RECOMMENDATIONS for t in entry.triggers}
    return [found[key] for key in sorted(found)]


def _trigger_counts(s, f):
    """How many customers each trigger of the catalogue holds for, alone."""
    counts = [
        F.struct(F.lit(t.attribute).alias("attribute"), F.lit(t.op).alias("op"), F.lit(str(t.value)).alias("value"),
                 F.count_if(r.trigger_predicate(t)).alias("customers"))
        for t in _triggers()
    ]
    rows = r.profiles(customers_table(s, f)).groupBy(*UPLOAD).agg(F.array(*counts).alias("_counts"))
    return rows.select(*UPLOAD, F.explode("_counts").alias("_c")).select(*UPLOAD, "_c.*")


def _entries_by_category(s, f):
    """The entries of each category, looked up, with the customers who got them; each entry's title looked up by its id."""
    looked = reduce(DataFrame.unionByName, [
        r.catalogue_lookup(s, category=c).select("category", "recommendation_id") for c in sorted({e.category for e in RECOMMENDATIONS})])
    titles = reduce(DataFrame.unionByName, [r.catalogue_lookup(s, recommendation_id=e.id).select("recommendation_id", "title") for e in RECOMMENDATIONS])
    got = best_actions_table(s, f).groupBy(*UPLOAD, "recommendation_id").agg(F.count("*").alias("customers"))
    return got.join(F.broadcast(looked.join(titles, "recommendation_id")), "recommendation_id")


QUERIES = {
    "h2_trigger_counts": _trigger_counts,
    "h17_category_catalogue": _entries_by_category,
    "h1_profiles": lambda s, f: r.profiles(customers_table(s, f)).select(
        *KEYS, "lifecycle_stage", "segment", "return_rate", "net_revenue", "days_since_last_order", "avg_days_between_orders"
    ),
    "h3_rule_matches": lambda s, f: r.matched(r.profiles(customers_table(s, f))).select(
        *KEYS, F.explode("matches").alias("position")
    ),
    "h8_scores": lambda s, f: _ranked(s, f).select(
        *KEYS, "recommendation_id", "urgency", "business_impact", "confidence", "customer_value", "total_score"
    ),
    "h9_ranked_recommendations": lambda s, f: _ranked(s, f).select(*KEYS, "rank", "recommendation_id", "category"),
    "h10_opportunity_scores": lambda s, f: _ranked(s, f).select(*KEYS, "recommendation_id", "opportunity_score"),
    "h11_customer_opportunity": lambda s, f: best_actions_table(s, f).select(*KEYS, "opportunity_score"),
    "h12_explanations": _explained,
    "h13_best_action": lambda s, f: acted_customers(s, f).select(
        *KEYS, "recommended_action", "action_reason", "action_priority", "suggested_channel", "suggested_timing"
    ),
    "h14_commercial_value": lambda s, f: members_table(s, f).select(*KEYS, "category", "commercial_value"),
    "h15_plan_actions": lambda s, f: plan_table(s, f),
    "h15_plan_totals": lambda s, f: p.plan_totals(plan_table(s, f), UPLOAD),
    "h15_nested_plan": _nested,
    "h16_action_groups": lambda s, f: p.action_groups(plan_table(s, f), UPLOAD),
    "h17_stage_catalogue": _entries_by_stage,
    "h18_plan_lines": lambda s, f: p.plan_lines(plan_table(s, f), UPLOAD),
}

_KEYS = "tenant_id, upload_id, customer_key"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _own(table: dict[str, str], otherwise: str) -> str:
    cases = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items())
    return f"CASE recommendation_id {cases} ELSE {otherwise} END"


def _pounds(value: str) -> str:
    return f"'£' || format('{{:,}}', CAST(round_even({value}, 0) AS BIGINT))"


_IMPACT_TEXT = """, impact_texts(recommendation_id, impact_text) AS (VALUES
  ('rec-going-quiet-reengagement', 'revenue at risk from a cooling repeat buyer'),
  ('rec-lapsed-win-back-sequence', 'win-back cost is 5× cheaper than acquiring a new customer'),
  ('rec-sms-at-risk-nudge', 'high-urgency retention touchpoint for valuable buyers'),
  ('rec-onboarding-sequence', '30-day post-purchase window is highest-leverage retention moment'),
  ('rec-product-recommendation', 'incremental revenue from relevant product suggestions'),
  ('rec-cross-sell-complementary', 'expand basket size through complementary product pairing'),
  ('rec-free-shipping-second-purchase', 'second-order conversion with controlled margin impact'),
  ('rec-meta-ads-retarget', 'paid retargeting to recover slipping customers'),
  ('rec-tiktok-ads-lookalike', 'scale acquisition using high-quality new customer signals'),
  ('rec-restock-notification', 'capture demand when anchor product returns to stock'),
  ('rec-reduce-discount-frequency', 'margin improvement from reduced promotional dependency'),
  ('rec-vip-early-access', 'deepens emotional loyalty with exclusivity'),
  ('rec-loyalty-programme-reward', 'structured loyalty increases repeat purchase frequency'),
  ('rec-free-gift-champion', 'surprise gifting drives advocacy and repeat purchases'),
  ('rec-instagram-engagement', 'social engagement builds community and word-of-mouth'))"""

_WHY = _own(WHY_TEXT, """CASE
  WHEN is_lapsed THEN 'This customer has not purchased in ' || days_since_last_order || ' days and matches the ' || lower(title) || ' criteria.'
  WHEN is_at_risk THEN 'This customer is overdue compared to their normal buying pattern, triggering a ' || replace(category, '_', ' ') || ' action.'
  WHEN is_new_customer THEN 'As a recent first-time buyer, this customer is in the critical post-purchase retention window.'
  WHEN is_one_time_buyer THEN 'This customer has only purchased once — converting them to a repeat buyer is the priority.'
  WHEN is_discount_dependent THEN 'This customer''s heavy discount usage is squeezing margin — testing full-price behaviour is recommended.'
  WHEN is_full_price_loyal THEN 'This loyal full-price buyer should be rewarded with exclusivity, not discounts.'
  ELSE 'This customer matches the conditions for ''' || title || ''' based on their ' || replace(stage, '_', ' ') || ' lifecycle stage.' END""")

_BEHAVIOUR = f"""concat_ws('. ',
  'This customer has spent ' || {_pounds('total_revenue')} || ' across ' || order_count || CASE WHEN order_count = 1 THEN ' order' ELSE ' orders' END,
  CASE WHEN discount_usage_rate = 0 THEN 'has never used a discount'
       WHEN round_even(discount_usage_rate * 100, 0) >= 70 THEN 'used a discount on ' || CAST(round_even(discount_usage_rate * 100, 0) AS BIGINT) || '% of orders'
       ELSE 'uses discounts on ' || CAST(round_even(discount_usage_rate * 100, 0) AS BIGINT) || '% of orders' END,
  CASE WHEN avg_days_between_orders > 0 AND is_repeat_customer
       THEN 'and normally purchases every ' || CAST(round_even(avg_days_between_orders, 0) AS BIGINT) || ' days' END,
  CASE WHEN days_since_last_order >= 0 THEN CASE
    WHEN is_at_risk AND avg_days_between_orders > 0 THEN 'but their last order was ' || days_since_last_order || ' days ago — significantly overdue'
    WHEN is_lapsed THEN 'with no purchase in ' || days_since_last_order || ' days'
    WHEN is_new_customer THEN 'with their first purchase ' || days_since_last_order || ' days ago'
    WHEN is_one_time_buyer THEN 'with their only purchase ' || days_since_last_order || ' days ago' END END,
  'their most-bought item is ' || most_bought_product,
  CASE WHEN is_high_return_risk AND total_revenue > 0
       THEN 'They have a return rate of ' || CAST(round_even(return_rate * 100, 0) AS BIGINT) || '%' END) || '.'"""

_IMPORTANCE = f"""CASE impact_type
  WHEN 'revenue_at_risk' THEN CASE WHEN is_at_risk AND NOT is_lapsed
    THEN 'With ' || {_pounds('total_revenue')} || ' in lifetime spend, retention is a higher priority than acquisition — acting now prevents a high-value customer from lapsing.'
    ELSE 'An estimated ' || {_pounds('total_revenue')} || ' in customer lifetime value is at risk if no action is taken.' END
  WHEN 'revenue_opportunity' THEN 'There is an estimated ' || {_pounds('greatest(aov, impact_value::DOUBLE)')} || ' revenue opportunity from converting this customer to their next purchase.'
  WHEN 'margin_improvement' THEN CASE WHEN total_discount_amount > 0
    THEN 'Reducing unnecessary discounting could recover up to ' || {_pounds('total_discount_amount')} || ' in margin across this customer''s history.'
    ELSE 'Protecting full-price purchase behaviour preserves margin — discounting this customer would train them to wait for sales.' END
  ELSE 'This customer contributes ' || {_pounds('total_revenue')} || ' in revenue — strengthening loyalty protects long-term brand advocacy and repeat purchases.' END"""

_OUTCOME = _own(OUTCOME_TEXT, "'Following this recommendation via ' || replace(channel, '_', ' ') || ' is expected to deliver ' || impact_text || ' if executed ' || replace(timing, '_', ' ') || '.'")


# The customers as acted upon, with the reason of their action: the best recommendation's four texts, else the baseline's.
TOLD = _IMPACT_TEXT + f""",
reasons AS (SELECT {_KEYS}, concat_ws(' ', {_WHY}, {_BEHAVIOUR}, {_IMPORTANCE}, {_OUTCOME}) AS summary
  FROM best LEFT JOIN impact_texts USING (recommendation_id)),
told AS (SELECT a.* REPLACE (coalesce(r.summary, a.action_reason) AS action_reason) FROM acted a LEFT JOIN reasons r USING ({_KEYS}))"""


def _title(column: str) -> str:
    return f"array_to_string([upper(w[1]) || w[2:] FOR w IN string_split({column}, '_')], ' ')"


_TOTALS = """
, sections AS (SELECT tenant_id, upload_id, section_position, section, CAST(sum(customer_count) AS BIGINT) AS customer_count,
    CAST(sum(CAST(estimated_commercial_value AS DECIMAL(38,2))) AS DOUBLE) AS estimated_commercial_value, count(*) AS actions
  FROM actions GROUP BY ALL),
plans AS (SELECT tenant_id, upload_id, CAST(NULL AS INT) AS section_position, CAST(NULL AS VARCHAR) AS section,
    CAST(sum(customer_count) AS BIGINT) AS customer_count,
    CAST(sum(CAST(estimated_commercial_value AS DECIMAL(38,2))) AS DOUBLE) AS estimated_commercial_value, count(*) AS actions
  FROM actions GROUP BY ALL)"""

def _condition(trigger) -> str:
    if trigger.value is None:
        return f"{trigger.attribute} IS {'NOT ' if trigger.op == 'neq' else ''}NULL"
    sign = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[trigger.op]
    return f"{trigger.attribute} {sign} {str(trigger.value).upper() if isinstance(trigger.value, bool) else repr(trigger.value)}"


SQL = {
    "h2_trigger_counts": with_recommended(" UNION ALL ".join(
        f"""SELECT tenant_id, upload_id, '{t.attribute}' AS attribute, '{t.op}' AS op, '{t.value}' AS value,
  count(*) FILTER (WHERE {_condition(t)}) AS customers FROM profiles GROUP BY ALL
""" for t in _triggers())),
    "h17_category_catalogue": with_recommended("""
SELECT tenant_id, upload_id, recommendation_id, category, title, count(*) AS customers FROM best GROUP BY ALL"""),
    "h1_profiles": with_recommended(
        f"SELECT {_KEYS}, stage AS lifecycle_stage, segment, return_rate, net_revenue, days_since_last_order, avg_days_between_orders FROM profiles"
    ),
    "h3_rule_matches": with_recommended(f"SELECT {_KEYS}, position FROM hits"),
    "h8_scores": with_recommended(
        f"SELECT {_KEYS}, recommendation_id, urgency, business_impact, confidence, customer_value, total_score FROM ranked"
    ),
    "h9_ranked_recommendations": with_recommended(f"SELECT {_KEYS}, rank, recommendation_id, category FROM ranked"),
    "h10_opportunity_scores": with_recommended(f"SELECT {_KEYS}, recommendation_id, opportunity_score FROM ranked"),
    "h11_customer_opportunity": with_recommended(f"""
, o AS (SELECT {_KEYS}, max(opportunity_score) AS best_score FROM ranked GROUP BY ALL)
SELECT {_KEYS}, coalesce(best_score, 0.0) AS opportunity_score FROM customers LEFT JOIN o USING ({_KEYS})"""),
    "h12_explanations": with_recommended(_IMPACT_TEXT + f"""
SELECT {_KEYS}, recommendation_id, {_WHY} AS why_selected, {_BEHAVIOUR} AS supporting_behaviour,
  {_IMPORTANCE} AS commercial_importance, {_OUTCOME} AS expected_outcome
FROM best LEFT JOIN impact_texts USING (recommendation_id)"""),
    "h13_best_action": with_recommended(
        TOLD + f"SELECT {_KEYS}, recommended_action, action_reason, action_priority, suggested_channel, suggested_timing FROM told"
    ),
    "h14_commercial_value": with_recommended(f"SELECT {_KEYS}, category, commercial_value FROM best"),
    "h15_plan_actions": with_recommended(
        f"SELECT * EXCLUDE (channel_code, timing_code), {_title('channel_code')} AS channel, {_title('timing_code')} AS timing FROM actions"
    ),
    "h15_plan_totals": with_recommended(_TOTALS + "SELECT * FROM sections UNION ALL SELECT * FROM plans"),
    "h15_nested_plan": with_recommended(_TOTALS + """
SELECT tenant_id, upload_id, p.customer_count AS total_customers, p.estimated_commercial_value AS total_commercial_value,
  count(*) AS section_count, string_agg(s.section, ',' ORDER BY s.section_position) AS section_names,
  p.actions AS action_count
FROM sections s JOIN plans p USING (tenant_id, upload_id) GROUP BY ALL"""),
    "h16_action_groups": with_recommended(f"""
SELECT tenant_id, upload_id, action, trim(regexp_replace(lower(action), '[^a-z0-9]+', '-', 'g'), '-') AS action_key,
  priority AS action_priority, customer_count, estimated_commercial_value AS total_revenue_at_stake,
  {_title('channel_code')} AS suggested_channel, {_title('timing_code')} AS suggested_timing,
  row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
                     customer_count DESC, section_position, catalogue_position) AS position
FROM actions"""),
    "h17_stage_catalogue": with_recommended("""
, listed AS (SELECT position, unnest(stages) AS stage FROM (VALUES
  (1,['lapsed','vip']),(2,['going_quiet','vip']),(3,['going_quiet']),(4,['lapsed']),(5,['going_quiet','vip']),(6,['new']),
  (7,['one_time_buyer']),(8,['regular','vip']),(9,['regular','vip','one_time_buyer']),(10,['one_time_buyer']),
  (11,['going_quiet','one_time_buyer']),(12,['new']),(13,['regular','vip']),(14,['discount_shopper']),(15,['vip','regular']),
  (16,['discount_shopper']),(17,['vip']),(18,['vip']),(19,['vip','regular']),(20,['vip']),(21,['new','vip']),
  (22,['regular','new','one_time_buyer','going_quiet','lapsed','discount_shopper','vip'])) t(position, stages)),
per AS (SELECT stage, count(*) AS entries FROM listed GROUP BY ALL)
SELECT tenant_id, upload_id, stage AS lifecycle_stage, any_value(entries) AS entries, count(*) AS customers
FROM profiles JOIN per USING (stage) GROUP BY tenant_id, upload_id, stage"""),
    "h18_plan_lines": with_recommended(_TOTALS + f"""
, ord AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY section_position, customer_count DESC, catalogue_position) AS position FROM actions),
ls AS (
  SELECT tenant_id, upload_id, 0 AS s, 0 AS p, 0 AS i, 0 AS l, 'Weekly Growth Plan' AS text FROM plans
  UNION ALL SELECT tenant_id, upload_id, 0, 0, 0, 1, repeat('=', 40) FROM plans
  UNION ALL SELECT tenant_id, upload_id, 0, 0, 0, 2, '' FROM plans
  UNION ALL SELECT tenant_id, upload_id, 9, 0, 0, 0, 'Plan total: ' || customer_count || ' customers, ' || {_pounds('estimated_commercial_value')} FROM plans
  UNION ALL SELECT tenant_id, upload_id, section_position, 0, 0, 0, section FROM sections
  UNION ALL SELECT tenant_id, upload_id, section_position, 2, 0, 0, '  Section total: ' || customer_count || ' customers, ' || {_pounds('estimated_commercial_value')} FROM sections
  UNION ALL SELECT tenant_id, upload_id, section_position, 3, 0, 0, '' FROM sections
  UNION ALL SELECT tenant_id, upload_id, section_position, 1, position, 0, '  • ' || action || ' — ' || customer_count || CASE WHEN customer_count = 1 THEN ' customer' ELSE ' customers' END FROM ord
  UNION ALL SELECT tenant_id, upload_id, section_position, 1, position, 1, '    Estimated commercial value ' || {_pounds('estimated_commercial_value')} FROM ord)
SELECT tenant_id, upload_id, row_number() OVER (PARTITION BY tenant_id, upload_id ORDER BY s, p, i, l) AS line, text FROM ls"""),
}
