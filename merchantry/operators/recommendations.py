"""Rule-matched, scored and ranked recommendations per customer.

A customer's matches and scores are built as an array inside the customer's own
row: matching, scoring, ranking and the best action need no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import clamp, round_to, safe_div, title_words
from merchantry.operators.catalogue import (
    AOV_SCALE, IMPACT_BASE, IMPACT_SCORE, PRIORITY_SCORE, RECOMMENDATIONS, REVENUE_SCALE, STAGE_OF_SEGMENT,
    TIMING_SCORE, VALUE_SCALE, Recommendation, Trigger,
)
from merchantry.operators.customers import segment_rule
from merchantry.operators.rfm import lookup

TENANT = ["tenant_id"]


def profiles(customers: DataFrame) -> DataFrame:
    """H1: lifecycle stage and return rate; zero recency, gap and net revenue are
    read as missing, as the profile does."""
    def unless_zero(name: str, otherwise: Column) -> Column:
        return F.when(F.col(name).isNull() | (F.col(name) == 0), otherwise).otherwise(F.col(name))

    stage = lookup(F.col("_segment"), STAGE_OF_SEGMENT, "regular")
    return (
        customers.withColumn("_segment", segment_rule())
        .withColumn("lifecycle_stage", stage)
        .withColumn("return_rate", F.when(F.col("total_revenue") > 0, safe_div("refund_total", "total_revenue")).otherwise(0.0))
        .withColumn("net_revenue", unless_zero("net_revenue", F.col("total_revenue")))
        .withColumn("days_since_last_order", unless_zero("days_since_last_order", F.lit(-1).cast("bigint")))
        .withColumn("avg_days_between_orders", unless_zero("avg_days_between_orders", F.lit(-1.0)))
        .withColumn("segment", F.col("_segment"))
        .drop("_segment")
    )


# The attributes a trigger may name.
ATTRIBUTES = {
    "is_repeat_customer", "is_one_time_buyer", "is_lapsed", "is_discount_dependent", "is_full_price_loyal",
    "is_high_value", "is_new_customer", "is_at_risk", "is_high_return_risk", "lifecycle_stage", "segment",
    "days_since_last_order", "avg_days_between_orders", "purchase_frequency", "order_count", "total_revenue",
    "net_revenue", "aov", "discount_usage_rate", "total_discount_amount", "refund_total", "return_rate",
    "most_bought_product", "first_product_purchased", "distinct_products_purchased",
}


def trigger_predicate(trigger: Trigger) -> Column:
    """H2: one trigger as a predicate that is never null."""
    known = trigger.attribute in ATTRIBUTES
    actual = F.col(trigger.attribute) if known else F.lit(None)
    if trigger.op in ("eq", "neq"):
        if trigger.value is None:
            same = actual.isNull()
        elif not known:
            same = F.lit(False)
        else:
            same = F.coalesce(actual == F.lit(trigger.value), F.lit(False))
        return same if trigger.op == "eq" else ~same
    if trigger.op not in ("gt", "gte", "lt", "lte") or not known:
        return F.lit(False)
    left, right = actual.cast("double"), F.lit(float(trigger.value))
    test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[trigger.op]
    return F.coalesce(test, F.lit(False))


def rule_predicate(entry: Recommendation) -> Column:
    """H3: the stage is listed and every trigger holds."""
    matched = F.col("lifecycle_stage").isin(*entry.stages)
    for trigger in entry.triggers:
        matched = matched & trigger_predicate(trigger)
    return matched


def _entry_literals() -> Column:
    """The catalogue's numbers as one constant array, in catalogue order."""
    return F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(r.id).alias("id"),
            F.lit(r.category).alias("category"),
            F.lit(PRIORITY_SCORE[r.priority]).alias("priority_score"),
            F.lit(TIMING_SCORE[r.timing]).alias("timing_score"),
            F.lit(IMPACT_SCORE[r.impact_type]).alias("impact_score"),
            F.lit(IMPACT_BASE[r.impact_type]).alias("impact_base"),
            F.lit(r.impact_value).alias("impact_value"),
            F.lit(len(r.triggers)).alias("triggers"),
        )
        for i, r in enumerate(RECOMMENDATIONS)
    ])


def matched(profile: DataFrame) -> DataFrame:
    """H3: an array of the matching catalogue positions, in catalogue order."""
    hits = F.array(*[F.when(rule_predicate(r), F.lit(i + 1)) for i, r in enumerate(RECOMMENDATIONS)])
    return profile.withColumn("matches", F.filter(hits, lambda p: p.isNotNull()))


def _customer_signal() -> Column:
    days = F.col("days_since_last_order")
    window = F.col("is_one_time_buyer") & days.between(RULES.window_from_days, RULES.window_to_days)
    return (
        F.when(F.col("is_lapsed"), 1.0)
        .when(F.col("is_at_risk"), 0.90)
        .when(F.col("is_new_customer"), 0.70)
        .when(window, 0.75)
        .when(F.col("is_one_time_buyer"), 0.55)
        .otherwise(0.35)
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def _with_customer_parts(df: DataFrame) -> DataFrame:
    """What the scores take from the customer alone, computed once per row."""
    strong = (
        _flag("is_lapsed") + _flag("is_at_risk") + _flag("is_full_price_loyal") + _flag("is_discount_dependent")
        + _flag("is_high_value")
    )
    orders = F.col("order_count")
    revenue_share = clamp(F.col("total_revenue") / REVENUE_SCALE)
    value = clamp(
        F.lit(0.50) * revenue_share + F.lit(0.15) * clamp(F.col("aov") / AOV_SCALE)
        + F.when(F.col("is_high_value"), 0.25).otherwise(0.0)
        + F.when(F.col("is_repeat_customer"), 0.10).otherwise(0.0)
    )
    capped_share = F.least(F.col("total_revenue") / REVENUE_SCALE, F.lit(1.0))
    worth = F.least(
        capped_share * 70 + F.least(F.col("aov") / AOV_SCALE, F.lit(1.0)) * 15
        + F.when(F.col("is_high_value"), 15.0).otherwise(0.0),
        F.lit(100.0),
    )
    floor = (
        F.when(F.col("is_lapsed"), 85.0).when(F.col("is_at_risk"), 75.0).when(F.col("is_new_customer"), 60.0).otherwise(0.0)
    )
    return df.withColumns({
        "_signal": _customer_signal(),
        "_revenue_share": revenue_share,
        "_capped_share": capped_share,
        "_order_bonus": F.when(orders >= 5, 0.15).when(orders >= 2, 0.10).otherwise(0.0),
        "_flag_bonus": F.least(strong * F.lit(0.04), F.lit(0.20)),
        "_dated_bonus": F.when(F.col("days_since_last_order") >= 0, 0.05).otherwise(0.0),
        "_value": value,
        "_worth": worth,
        "_urgency_floor": floor,
    })


def _conversion(category: Column) -> Column:
    """How likely acting converts, by category."""
    window = F.col("is_one_time_buyer") & F.col("days_since_last_order").between(
        RULES.window_from_days, RULES.window_to_days
    )
    protect = (
        F.when(F.col("is_at_risk") & ~F.col("is_lapsed"), 65.0)
        .when(F.col("is_lapsed") & F.col("is_high_value"), 35.0)
        .when(F.col("is_lapsed"), 20.0)
        .otherwise(40.0)
    )
    grow = F.when(window, 55.0).when(F.col("is_new_customer"), 50.0).when(F.col("is_repeat_customer"), 45.0).otherwise(30.0)
    margin = (
        F.when(F.col("is_discount_dependent"), F.when(F.col("discount_usage_rate") > 0.85, 25.0).otherwise(40.0))
        .when(F.col("is_full_price_loyal"), 80.0)
        .otherwise(35.0)
    )
    loyalty = (
        F.when(F.col("is_full_price_loyal") & F.col("is_high_value"), 75.0)
        .when(F.col("is_repeat_customer"), 60.0)
        .otherwise(30.0)
    )
    return (
        F.when(category == "protect_revenue", protect)
        .when(category == "grow_revenue", grow)
        .when(category == "improve_margin", margin)
        .when(category == "strengthen_loyalty", loyalty)
        .otherwise(40.0)
    )


def scored(profile: DataFrame) -> DataFrame:
    """Per customer the array `recommendations`, best first, and `opportunity_score`.

    Best means: rounded total score, then priority, then catalogue order.
    """
    df = _with_customer_parts(matched(profile)).withColumn("_entries", _entry_literals())

    def parts(p: Column) -> Column:
        e = F.element_at("_entries", p)
        urgency = clamp(F.lit(0.45) * e["priority_score"] + F.lit(0.30) * e["timing_score"] + F.lit(0.25) * F.col("_signal"))
        impact = clamp(
            F.lit(0.40) * e["impact_score"] + F.lit(0.30) * clamp(e["impact_value"] / VALUE_SCALE)
            + F.lit(0.30) * F.col("_revenue_share")
        )
        trigger_bonus = F.when(e["triggers"] >= 3, 0.10).when(e["triggers"] == 2, 0.05).otherwise(0.0)
        confidence = clamp(
            F.lit(0.55) + trigger_bonus + F.col("_order_bonus") + F.col("_flag_bonus") + F.col("_dated_bonus")
        )
        total = clamp(
            F.lit(0.30) * urgency + F.lit(0.30) * impact + F.lit(0.20) * confidence + F.lit(0.20) * F.col("_value")
        )
        commercial = F.least(
            e["impact_base"] * 0.6 + F.least(e["impact_value"] / VALUE_SCALE, F.lit(1.0)) * 20
            + F.col("_capped_share") * 20,
            F.lit(100.0),
        )
        return F.struct(
            e["position"].alias("position"), e["id"].alias("id"), e["category"].alias("category"),
            e["priority_score"].alias("priority_score"),
            round_to(urgency, 4).alias("urgency"), round_to(impact, 4).alias("business_impact"),
            round_to(confidence, 4).alias("confidence"), round_to(total, 4).alias("total_score"),
            commercial.alias("commercial"),
        )

    def finished(r: Column) -> Column:
        pressing = F.least(F.greatest(r["urgency"] * 100, F.col("_urgency_floor")), F.lit(100.0))
        weighted = (
            F.lit(0.25) * F.col("_worth") + F.lit(0.30) * pressing + F.lit(0.25) * _conversion(r["category"])
            + F.lit(0.20) * r["commercial"]
        )
        # The first three fields are the sort order.
        return F.struct(
            (-r["total_score"]).alias("_total"), (-r["priority_score"]).alias("_priority"), r["position"].alias("position"),
            r["id"].alias("recommendation_id"), r["category"].alias("category"),
            r["urgency"].alias("urgency"), r["business_impact"].alias("business_impact"),
            r["confidence"].alias("confidence"), round_to(F.col("_value"), 4).alias("customer_value"),
            r["total_score"].alias("total_score"),
            round_to(clamp(weighted, 0.0, 100.0), 1).alias("opportunity_score"),
        )

    df = df.withColumn("_parts", F.transform("matches", parts))
    df = df.withColumn("recommendations", F.array_sort(F.transform("_parts", finished)))
    best = F.coalesce(F.array_max(F.transform("recommendations", lambda r: r["opportunity_score"])), F.lit(0.0))
    helpers = [c for c in df.columns if c.startswith("_") and c not in profile.columns]
    return df.withColumn("opportunity_score", best).drop(*helpers)


def ranked(scored_customers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H9: long form, one row per customer and recommendation, ranked from 1."""
    return scored_customers.select(*keys, F.posexplode("recommendations").alias("_at", "_rec")).select(
        *keys, (F.col("_at") + 1).alias("rank"), "_rec.position", "_rec.recommendation_id", "_rec.category",
        "_rec.urgency", "_rec.business_impact", "_rec.confidence", "_rec.customer_value", "_rec.total_score",
        "_rec.opportunity_score",
    )


def catalogue_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a table; 22 fixed rows, so always small enough to broadcast."""
    rows = [
        (i + 1, r.id, r.title, r.category, r.priority, r.timing, r.channel, list(r.stages), len(r.triggers),
         r.impact_type, r.impact_value, r.impact_text)
        for i, r in enumerate(RECOMMENDATIONS)
    ]
    return spark.createDataFrame(
        rows,
        "position int, recommendation_id string, title string, category string, priority string, timing string, "
        "channel string, stages array<string>, triggers int, impact_type string, impact_value double, impact_text string",
    )


def catalogue_lookup(
    spark: SparkSession, recommendation_id: str | None = None, category: str | None = None, stage: str | None = None
) -> DataFrame:
    """Entries by id, by category or by stage."""
    out = catalogue_table(spark)
    if recommendation_id is not None:
        out = out.where(F.col("recommendation_id") == recommendation_id)
    if category is not None:
        out = out.where(F.col("category") == category)
    if stage is not None:
        out = out.where(F.array_contains("stages", stage))
    return out


def top_recommendation(scored_customers: DataFrame) -> DataFrame:
    """Each customer's best recommendation with its catalogue texts, null if none."""
    spark = scored_customers.sparkSession
    texts = F.broadcast(
        catalogue_table(spark).select(
            F.col("recommendation_id"), F.col("title").alias("rec_title"), F.col("priority").alias("rec_priority"),
            F.col("channel").alias("rec_channel"), F.col("timing").alias("rec_timing"),
            F.col("impact_type").alias("rec_impact_type"), F.col("impact_value").alias("rec_impact_value"),
            F.col("impact_text").alias("rec_impact_text"), F.col("category").alias("rec_category"),
        )
    )
    best = F.try_element_at("recommendations", F.lit(1))
    return scored_customers.withColumn("recommendation_id", best["recommendation_id"]).join(
        texts, "recommendation_id", "left"
    )


def apply_best_action(customers: DataFrame, explained_top: DataFrame) -> DataFrame:
    """Write the best recommendation onto each customer; without one the
    baseline action stays. `explained_top` carries the same customers' rows."""
    return explained_top.select(
        *[c for c in customers.columns if c not in _ACTION_COLUMNS],
        F.coalesce("rec_title", "recommended_action").alias("recommended_action"),
        F.coalesce("summary", "action_reason").alias("action_reason"),
        F.coalesce("rec_priority", "action_priority").alias("action_priority"),
        F.coalesce(title_words("rec_channel"), F.col("suggested_channel")).alias("suggested_channel"),
        F.coalesce(title_words("rec_timing"), F.col("suggested_timing")).alias("suggested_timing"),
    )


_ACTION_COLUMNS = ["recommended_action", "action_reason", "action_priority", "suggested_channel", "suggested_timing"]
