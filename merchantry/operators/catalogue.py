"""Fixed rule catalogues. Rules are data; `recommendations` compiles them to columns.

Everything below is fixed values: names, texts, thresholds and weights.
"""

from __future__ import annotations

from typing import NamedTuple


class Trigger(NamedTuple):
    attribute: str
    op: str
    value: object


class Recommendation(NamedTuple):
    id: str
    title: str
    category: str
    priority: str
    timing: str
    channel: str
    stages: tuple[str, ...]
    triggers: tuple[Trigger, ...]
    impact_type: str
    impact_value: float
    impact_text: str


def _is(flag: str) -> Trigger:
    return Trigger(flag, "eq", True)


def _not(flag: str) -> Trigger:
    return Trigger(flag, "eq", False)


_KNOWN_FAVOURITE = Trigger("most_bought_product", "neq", None)

STAGE_OF_SEGMENT = {
    "VIPs": "vip",
    "Regulars": "regular",
    "New Customers": "new",
    "One-Time Buyers": "one_time_buyer",
    "Going Quiet": "going_quiet",
    "Lapsed": "lapsed",
    "Discount Shoppers": "discount_shopper",
}

RECOMMENDATIONS = [
    Recommendation(
        "rec-lapsed-hv-reengagement", "Send personal re-engagement email",
        "protect_revenue", "high", "immediately", "email", ("lapsed", "vip"),
        (_is("is_lapsed"), _is("is_high_value")),
        "revenue_at_risk", 150.0, "Estimated revenue at risk from losing a high-value lapsed customer",
    ),
    Recommendation(
        "rec-at-risk-win-back", "Send win-back email with genuine incentive",
        "protect_revenue", "high", "this_week", "email", ("going_quiet", "vip"),
        (_is("is_at_risk"), _is("is_high_value"), _not("is_lapsed")),
        "revenue_at_risk", 120.0, "Revenue recoverable before customer fully lapses",
    ),
    Recommendation(
        "rec-going-quiet-reengagement", "Send personal re-engagement email",
        "protect_revenue", "medium", "this_week", "email", ("going_quiet",),
        (_is("is_at_risk"), _is("is_repeat_customer"), _not("is_high_value")),
        "revenue_at_risk", 80.0, "Revenue at risk from a cooling repeat buyer",
    ),
    Recommendation(
        "rec-lapsed-win-back-sequence", "Send targeted win-back sequence",
        "protect_revenue", "medium", "this_month", "email", ("lapsed",),
        (_is("is_lapsed"), _not("is_high_value")),
        "revenue_at_risk", 60.0, "Win-back cost is 5× cheaper than acquiring a new customer",
    ),
    Recommendation(
        "rec-sms-at-risk-nudge", "Send SMS win-back nudge",
        "protect_revenue", "high", "this_week", "sms", ("going_quiet", "vip"),
        (_is("is_at_risk"), _is("is_high_value")),
        "revenue_at_risk", 100.0, "High-urgency retention touchpoint for valuable buyers",
    ),
    Recommendation(
        "rec-onboarding-sequence", "Send onboarding email sequence",
        "grow_revenue", "medium", "this_week", "email", ("new",),
        (_is("is_new_customer"),),
        "revenue_opportunity", 45.0, "30-day post-purchase window is highest-leverage retention moment",
    ),
    Recommendation(
        "rec-second-purchase-nudge", "Send second-purchase nudge",
        "grow_revenue", "medium", "this_week", "email", ("one_time_buyer",),
        (_is("is_one_time_buyer"), Trigger("days_since_last_order", "gte", 30),
         Trigger("days_since_last_order", "lte", 60)),
        "revenue_opportunity", 55.0, "Best window to convert first-time buyers to repeat purchasers",
    ),
    Recommendation(
        "rec-product-recommendation", "Send personalised product recommendation",
        "grow_revenue", "medium", "this_month", "product_recommendation", ("regular", "vip"),
        (_is("is_repeat_customer"), _KNOWN_FAVOURITE),
        "revenue_opportunity", 40.0, "Incremental revenue from relevant product suggestions",
    ),
    Recommendation(
        "rec-cross-sell-complementary", "Cross-sell complementary items",
        "grow_revenue", "medium", "this_month", "email", ("regular", "vip", "one_time_buyer"),
        (_KNOWN_FAVOURITE, Trigger("distinct_products_purchased", "eq", 1)),
        "revenue_opportunity", 35.0, "Expand basket size through complementary product pairing",
    ),
    Recommendation(
        "rec-free-shipping-second-purchase", "Offer free shipping on second purchase",
        "grow_revenue", "medium", "this_week", "free_shipping", ("one_time_buyer",),
        (_is("is_one_time_buyer"), Trigger("days_since_last_order", "gte", 21),
         Trigger("days_since_last_order", "lte", 45)),
        "revenue_opportunity", 30.0, "Second-order conversion with controlled margin impact",
    ),
    Recommendation(
        "rec-meta-ads-retarget", "Retarget with Meta Ads",
        "grow_revenue", "medium", "this_month", "meta_ads", ("going_quiet", "one_time_buyer"),
        (_is("is_at_risk"),),
        "revenue_opportunity", 50.0, "Paid retargeting to recover slipping customers",
    ),
    Recommendation(
        "rec-tiktok-ads-lookalike", "Acquire lookalikes via TikTok Ads",
        "grow_revenue", "low", "next_campaign", "tiktok_ads", ("new",),
        (_is("is_new_customer"), Trigger("aov", "gt", 0)),
        "revenue_opportunity", 25.0, "Scale acquisition using high-quality new customer signals",
    ),
    Recommendation(
        "rec-restock-notification", "Send restock notification",
        "grow_revenue", "medium", "this_week", "restock_notification", ("regular", "vip"),
        (_KNOWN_FAVOURITE, _is("is_repeat_customer")),
        "revenue_opportunity", 45.0, "Capture demand when anchor product returns to stock",
    ),
    Recommendation(
        "rec-test-full-price", "Test at full price — remove from promotion",
        "improve_margin", "low", "next_campaign", "email", ("discount_shopper",),
        (_is("is_discount_dependent"),),
        "margin_improvement", 20.0, "Margin recovered by reducing unnecessary discounting",
    ),
    Recommendation(
        "rec-exclude-from-discount-campaigns", "Tag and exclude from discount campaigns",
        "improve_margin", "medium", "immediately", "shopify_tags", ("vip", "regular"),
        (_is("is_full_price_loyal"), _is("is_repeat_customer")),
        "margin_improvement", 35.0, "Prevents training full-price buyers to wait for sales",
    ),
    Recommendation(
        "rec-reduce-discount-frequency", "Reduce discount frequency for dependent buyers",
        "improve_margin", "low", "next_campaign", "email", ("discount_shopper",),
        (_is("is_discount_dependent"), Trigger("discount_usage_rate", "gt", 0.85)),
        "margin_improvement", 15.0, "Margin improvement from reduced promotional dependency",
    ),
    Recommendation(
        "rec-vip-audience", "Add to VIP audience — no discount needed",
        "strengthen_loyalty", "medium", "this_month", "email", ("vip",),
        (_is("is_full_price_loyal"), _is("is_repeat_customer")),
        "loyalty_strengthening", 50.0, "Protects highest-margin loyal customers",
    ),
    Recommendation(
        "rec-vip-early-access", "Grant early access to new collection",
        "strengthen_loyalty", "medium", "this_month", "early_access", ("vip",),
        (_is("is_full_price_loyal"), _is("is_high_value")),
        "loyalty_strengthening", 60.0, "Deepens emotional loyalty with exclusivity",
    ),
    Recommendation(
        "rec-loyalty-programme-reward", "Reward via loyalty programme",
        "strengthen_loyalty", "medium", "this_month", "loyalty_programme", ("vip", "regular"),
        (_is("is_repeat_customer"), Trigger("order_count", "gte", 3)),
        "loyalty_strengthening", 40.0, "Structured loyalty increases repeat purchase frequency",
    ),
    Recommendation(
        "rec-free-gift-champion", "Send free gift to champion customer",
        "strengthen_loyalty", "medium", "this_month", "free_gift", ("vip",),
        (_is("is_high_value"), _is("is_full_price_loyal"), Trigger("order_count", "gte", 4)),
        "loyalty_strengthening", 55.0, "Surprise gifting drives advocacy and repeat purchases",
    ),
    Recommendation(
        "rec-instagram-engagement", "Engage on Instagram",
        "strengthen_loyalty", "low", "ongoing", "instagram", ("new", "vip"),
        (_is("is_new_customer"),),
        "loyalty_strengthening", 15.0, "Social engagement builds community and word-of-mouth",
    ),
    Recommendation(
        "rec-monitor-ongoing", "Monitor — maintain regular communications",
        "strengthen_loyalty", "low", "ongoing", "email",
        ("regular", "new", "one_time_buyer", "going_quiet", "lapsed", "discount_shopper", "vip"),
        (_not("is_lapsed"), _not("is_at_risk"), _not("is_new_customer"), _not("is_one_time_buyer"),
         _not("is_discount_dependent"), _not("is_full_price_loyal")),
        "loyalty_strengthening", 5.0, "Baseline relationship maintenance",
    ),
]

# Score tables and weights.
PRIORITY_SCORE = {"high": 1.0, "medium": 0.65, "low": 0.35}
PRIORITY_ORDER = {"high": 0, "medium": 1, "low": 2}
TIMING_SCORE = {"immediately": 1.0, "this_week": 0.90, "this_month": 0.70, "next_campaign": 0.50, "ongoing": 0.25}
IMPACT_SCORE = {
    "revenue_at_risk": 1.0, "revenue_opportunity": 0.85, "margin_improvement": 0.70, "loyalty_strengthening": 0.60,
}
IMPACT_BASE = {
    "revenue_at_risk": 90.0, "revenue_opportunity": 75.0, "margin_improvement": 60.0, "loyalty_strengthening": 55.0,
}
VALUE_SCALE = 500.0
REVENUE_SCALE = 1000.0
AOV_SCALE = 150.0

# Plan sections in their order.
SECTIONS = {
    "protect_revenue": "Protect Revenue",
    "grow_revenue": "Grow Revenue",
    "improve_margin": "Improve Margin",
    "strengthen_loyalty": "Strengthen Loyalty",
}

# Why a recommendation was selected, for the entries with a text of their own.
WHY_TEXT = {
    "rec-lapsed-hv-reengagement":
        "This high-value customer has lapsed and needs personal re-engagement before they are lost permanently.",
    "rec-at-risk-win-back":
        "This valuable repeat buyer is past 2× their usual purchase gap — the win-back window is open now.",
    "rec-second-purchase-nudge":
        "This one-time buyer is in the 30–60 day conversion window — the highest-leverage moment to drive a second "
        "purchase.",
    "rec-vip-audience":
        "This customer buys repeatedly at full price and should be treated as VIP — not placed on discount lists.",
    "rec-test-full-price":
        "This customer is discount-dependent and may buy at full price if removed from the next promotion.",
    "rec-monitor-ongoing":
        "No urgent behavioural signal was detected — maintain regular communication and monitor for changes.",
}

# Expected outcome, for the entries with a text of their own.
OUTCOME_TEXT = {
    "rec-lapsed-hv-reengagement":
        "A personal check-in email can recover 10–20% of lapsed high-value customers without eroding margin with "
        "discounts.",
    "rec-at-risk-win-back":
        "A timely win-back email this week gives the best chance of recovery before the customer fully lapses.",
    "rec-second-purchase-nudge":
        "A well-timed second-purchase nudge can double the conversion rate compared to no follow-up.",
    "rec-vip-audience":
        "Excluding this customer from discount campaigns preserves margin and reinforces their VIP status.",
    "rec-test-full-price":
        "Testing at full price reveals true customer LTV — those who still buy are more valuable than assumed.",
    "rec-exclude-from-discount-campaigns":
        "Tagging and excluding from promotions prevents training a full-price buyer to wait for sales.",
    "rec-monitor-ongoing":
        "Maintaining consistent communication keeps the brand top-of-mind until a stronger signal emerges.",
}

# Lifecycle segment colours as shown to readers.
SEGMENT_COLOURS = {
    "VIPs": "#7C3AED",
    "Regulars": "#2563EB",
    "New Customers": "#059669",
    "One-Time Buyers": "#D97706",
    "Going Quiet": "#DC2626",
    "Lapsed": "#6B7280",
    "Discount Shoppers": "#EA580C",
}
SEGMENT_DEFAULT_COLOUR = "#94a3b8"


class Benchmark(NamedTuple):
    description: str
    why: str
    how_to_treat: str
    typical_pct: str
    benchmark_note: str


SEGMENT_BENCHMARKS = {
    "VIPs": Benchmark(
        "Your highest-value, full-price loyal buyers.",
        "They generate the most revenue and buy without needing a discount — protecting them from promotion lists "
        "preserves your margins.",
        "Reward with exclusivity (early access, personal notes) — never with discounts.",
        "5–10% of customers, 25–40% of revenue",
        "Healthy brands see VIPs at 5–10% of base. Below 5%? Focus on converting Regulars up.",
    ),
    "Regulars": Benchmark(
        "Repeat buyers who purchase at a steady pace.",
        "These customers drive the backbone of your recurring revenue and are most likely to refer others.",
        "Stay top of mind with consistent communication. Personalise by most-bought product.",
        "15–25% of customers, 30–40% of revenue",
        "If Regulars are under 15%, your second-purchase conversion needs work.",
    ),
    "New Customers": Benchmark(
        "First-time buyers in the last 30 days.",
        "The 30-day post-purchase window is the highest-leverage retention moment. Most churn happens here.",
        "Send an onboarding sequence (3–4 emails, not automated welcome spam). Make them feel noticed.",
        "10–20% per month in a growing brand",
        "New customers should be turning into Regulars within 60 days — if not, check your onboarding.",
    ),
    "One-Time Buyers": Benchmark(
        "Customers who bought exactly once.",
        "60–80% of first-time buyers never return without a specific nudge. This is your biggest revenue leak.",
        "Send a second-purchase nudge at 30–45 days. Use the product they bought to personalise.",
        "30–50% of total base — should shrink over time",
        "If One-Time Buyers exceed 50% of your base, your retention is your #1 problem.",
    ),
    "Going Quiet": Benchmark(
        "Repeat buyers who are overdue by their own standards.",
        "They've shown they can buy again — they just haven't. Targeted re-engagement recovers 10–20% of this group.",
        "Personal re-engagement email referencing their last product. Not a batch discount blast.",
        "5–15% of customers",
        "Going Quiet above 15%? Your email frequency or relevance may be slipping.",
    ),
    "Lapsed": Benchmark(
        "Customers with no purchase in 180+ days.",
        "Still worth trying — the cost to win back a lapsed customer is 5× cheaper than acquiring a new one.",
        "One targeted win-back attempt, then move them to a low-frequency list. Don't spam.",
        "Under 15% is healthy — above 25% signals a retention emergency",
        "Lapsed above 20% means your brand is not keeping customers engaged past a single season.",
    ),
    "Discount Shoppers": Benchmark(
        "Buyers who used a discount on 70%+ of their orders.",
        "Discount-dependent customers squeeze margin and anchor to sale prices — over time they only buy on promotion.",
        "Test removing them from the next promotion. Some will buy anyway. The ones who don't — that's their true LTV.",
        "Under 15% is healthy",
        "If Discount Shoppers are above 20%, check whether your promotions are training buyers to wait.",
    ),
}

# Portfolio triggers: id, title, category, metric, operator, value.
PORTFOLIO_TRIGGERS = [
    ("retention-lapsed-high-value", "High-value customers have gone cold",
     "retention_risk", "lapsed_high_value_count", "gte", 1.0),
    ("retention-at-risk-high-value", "Win-back window open for valuable buyers",
     "retention_risk", "at_risk_high_value_count", "gte", 1.0),
    ("retention-overall-lapse-rate", "Lapse rate above healthy levels",
     "retention_risk", "lapsed_pct", "gt", 15.0),
    ("retention-going-quiet-segment", "Going Quiet segment is growing",
     "retention_risk", "going_quiet_pct", "gt", 15.0),
    ("retention-customer-concentration", "Revenue concentrated in top 10% of customers",
     "retention_risk", "top_10_pct_revenue_share", "gt", 50.0),
    ("revenue-second-purchase-window", "One-time buyers in the conversion window",
     "revenue_opportunity", "one_time_buyer_30_60_count", "gte", 1.0),
    ("revenue-going-quiet-recovery", "Recoverable revenue in Going Quiet segment",
     "revenue_opportunity", "at_risk_count", "gte", 5.0),
    ("revenue-new-customer-pipeline", "Strong new customer acquisition pipeline",
     "revenue_opportunity", "new_customer_count", "gte", 3.0),
    ("discount-dependency", "Discount-dependent customers squeezing margin",
     "discount_inefficiency", "discount_dependent_count", "gte", 1.0),
    ("discount-shopper-overweight", "Discount Shoppers segment above healthy levels",
     "discount_inefficiency", "discount_dependent_pct", "gt", 20.0),
    ("loyalty-full-price-loyalists", "Full-price loyalists are your highest-margin customers",
     "loyalty", "full_price_loyalist_count", "gte", 1.0),
    ("loyalty-vip-underweight", "VIP segment below healthy benchmark",
     "loyalty", "vip_pct", "lt", 5.0),
    ("loyalty-champion-concentration", "Champion customers driving disproportionate value",
     "loyalty", "champion_count", "gte", 3.0),
    ("cross-sell-product-concentration", "Single product dominates customer preferences",
     "cross_sell", "top_product_concentration_pct", "gt", 40.0),
    ("cross-sell-single-product-buyers", "Customers buying only one product type",
     "cross_sell", "single_product_buyer_pct", "gt", 30.0),
    ("upsell-low-aov-repeat-buyers", "Repeat buyers with below-average order value",
     "upsell", "low_aov_repeat_count", "gte", 5.0),
    ("upsell-regulars-to-vip", "Regulars ready for VIP elevation",
     "upsell", "regulars_ready_for_vip_count", "gte", 5.0),
    ("inventory-seasonal-concentration", "Purchases concentrated in one season",
     "inventory", "peak_month_pct", "gt", 30.0),
    ("inventory-anchor-sku-risk", "Anchor product stock risk",
     "inventory", "top_product_concentration_pct", "gt", 35.0),
    ("returns-high-portfolio-rate", "High return rate across customer base",
     "returns", "high_return_risk_count", "gte", 3.0),
    ("returns-new-customer-quality", "New customers returning at high rates",
     "returns", "new_customer_high_return_count", "gte", 2.0),
    ("growth-low-repeat-rate", "Repeat purchase rate below benchmark",
     "customer_growth", "repeat_rate_pct", "lt", 30.0),
    ("growth-one-time-buyer-overweight", "One-Time Buyers dominate the customer base",
     "customer_growth", "one_time_buyer_pct", "gt", 50.0),
    ("growth-new-customer-quality", "New customers spending above average",
     "customer_growth", "new_aov_premium_pct", "gt", 10.0),
    ("growth-lapsed-recovery-pool", "Large lapsed customer recovery pool",
     "customer_growth", "lapsed_count", "gte", 10.0),
]
