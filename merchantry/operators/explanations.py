"""Explanation texts for a recommendation given to a customer.

Works on rows that hold the customer's profile and the columns `recommendation_id`,
`rec_title`, `rec_category`, `rec_channel`, `rec_timing`, `rec_impact_type`,
`rec_impact_value` and `rec_impact_text`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.expressions import plural, pounds, whole, words
from merchantry.operators.catalogue import OUTCOME_TEXT, WHY_TEXT


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _own_text(table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[F.col("recommendation_id")]


def why_selected() -> Column:
    """The entry's own text, else one by the customer's first matching flag."""
    # Sentence patterns.
    by_flag = (
        F.when(
            F.col("is_lapsed"),
            F.concat(
                F.lit("This customer has not purchased in "), _text("days_since_last_order"),
                F.lit(" days and matches the "), F.lower("rec_title"), F.lit(" criteria."),
            ),
        )
        .when(
            F.col("is_at_risk"),
            F.concat(
                F.lit("This customer is overdue compared to their normal buying pattern, triggering a "),
                words("rec_category"), F.lit(" action."),
            ),
        )
        .when(
            F.col("is_new_customer"),
            F.lit("As a recent first-time buyer, this customer is in the critical post-purchase retention window."),
        )
        .when(
            F.col("is_one_time_buyer"),
            F.lit("This customer has only purchased once — converting them to a repeat buyer is the priority."),
        )
        .when(
            F.col("is_discount_dependent"),
            F.lit("This customer's heavy discount usage is squeezing margin — testing full-price behaviour is recommended."),
        )
        .when(
            F.col("is_full_price_loyal"),
            F.lit("This loyal full-price buyer should be rewarded with exclusivity, not discounts."),
        )
        .otherwise(
            F.concat(
                F.lit("This customer matches the conditions for '"), F.col("rec_title"),
                F.lit("' based on their "), words("lifecycle_stage"), F.lit(" lifecycle stage."),
            )
        )
    )
    return F.coalesce(_own_text(WHY_TEXT), by_flag)


def supporting_behaviour() -> Column:
    """What the customer did: spend, discounts, cadence, recency, product, returns."""
    orders, days, gap = F.col("order_count"), F.col("days_since_last_order"), F.col("avg_days_between_orders")
    rate = F.col("discount_usage_rate")
    share = whole(rate * 100)
    has_cadence = gap > 0

    # Sentence patterns.
    spent = F.concat(F.lit("This customer has spent "), pounds("total_revenue"))
    spent = F.when(
        orders > 0, F.concat(spent, F.lit(" across "), _text(orders), F.lit(" order"), plural(orders))
    ).otherwise(spent)
    discounts = (
        F.when(rate == 0, "has never used a discount")
        .when(share >= 70, F.concat(F.lit("used a discount on "), _text(share), F.lit("% of orders")))
        .otherwise(F.concat(F.lit("uses discounts on "), _text(share), F.lit("% of orders")))
    )
    cadence = F.when(
        has_cadence & F.col("is_repeat_customer"),
        F.concat(F.lit("and normally purchases every "), _text(whole(gap)), F.lit(" days")),
    )
    recency = F.when(
        days >= 0,
        F.when(
            F.col("is_at_risk") & has_cadence,
            F.concat(F.lit("but their last order was "), _text(days), F.lit(" days ago — significantly overdue")),
        )
        .when(F.col("is_lapsed"), F.concat(F.lit("with no purchase in "), _text(days), F.lit(" days")))
        .when(F.col("is_new_customer"), F.concat(F.lit("with their first purchase "), _text(days), F.lit(" days ago")))
        .when(F.col("is_one_time_buyer"), F.concat(F.lit("with their only purchase "), _text(days), F.lit(" days ago"))),
    )
    favourite = F.when(
        F.length("most_bought_product") > 0,
        F.regexp_replace(
            F.trim(F.concat(F.lit("their most-bought item is "), F.col("most_bought_product"))), "[.]+$", ""
        ),
    )
    returns = F.when(
        F.col("is_high_return_risk") & (F.col("total_revenue") > 0),
        F.concat(F.lit("They have a return rate of "), _text(whole(F.col("return_rate") * 100)), F.lit("%")),
    )
    return F.concat(F.concat_ws(". ", spent, discounts, cadence, recency, favourite, returns), F.lit("."))


def commercial_importance() -> Column:
    """What is at stake, by the entry's impact type."""
    spend = pounds("total_revenue")
    given = F.col("total_discount_amount")
    kind = F.col("rec_impact_type")
    # Sentence patterns.
    return (
        F.when(
            kind == "revenue_at_risk",
            F.when(
                F.col("is_at_risk") & ~F.col("is_lapsed"),
                F.concat(
                    F.lit("With "), spend,
                    F.lit(" in lifetime spend, retention is a higher priority than acquisition — acting now prevents a "
                          "high-value customer from lapsing."),
                ),
            ).otherwise(
                F.concat(
                    F.lit("An estimated "), spend,
                    F.lit(" in customer lifetime value is at risk if no action is taken."),
                )
            ),
        )
        .when(
            kind == "revenue_opportunity",
            F.concat(
                F.lit("There is an estimated "), pounds(F.greatest(F.col("aov"), F.col("rec_impact_value"))),
                F.lit(" revenue opportunity from converting this customer to their next purchase."),
            ),
        )
        .when(
            kind == "margin_improvement",
            F.when(
                given > 0,
                F.concat(
                    F.lit("Reducing unnecessary discounting could recover up to "), pounds(given),
                    F.lit(" in margin across this customer's history."),
                ),
            ).otherwise(
                F.lit("Protecting full-price purchase behaviour preserves margin — discounting this customer would train "
                      "them to wait for sales.")
            ),
        )
        .when(
            kind == "loyalty_strengthening",
            F.concat(
                F.lit("This customer contributes "), spend,
                F.lit(" in revenue — strengthening loyalty protects long-term brand advocacy and repeat purchases."),
            ),
        )
    )


def expected_outcome() -> Column:
    # Sentence patterns.
    general = F.concat(
        F.lit("Following this recommendation via "), words("rec_channel"), F.lit(" is expected to deliver "),
        F.lower("rec_impact_text"), F.lit(" if executed "), words("rec_timing"), F.lit("."),
    )
    return F.coalesce(_own_text(OUTCOME_TEXT), general)


def explained(rows: DataFrame) -> DataFrame:
    """The four texts and their summary; null without a recommendation."""
    there = F.col("recommendation_id").isNotNull()
    texts = rows.withColumns({
        "why_selected": F.when(there, why_selected()),
        "supporting_behaviour": F.when(there, supporting_behaviour()),
        "commercial_importance": F.when(there, commercial_importance()),
        "expected_outcome": F.when(there, expected_outcome()),
    })
    parts = ["why_selected", "supporting_behaviour", "commercial_importance", "expected_outcome"]
    return texts.withColumn("summary", F.when(there, F.concat_ws(" ", *parts)))
