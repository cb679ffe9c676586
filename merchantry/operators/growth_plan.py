"""Weekly growth plan: every customer's best action, grouped into four sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.expressions import exact_sum, plural, pounds, round_to, slug, title_words
from merchantry.operators.catalogue import SECTIONS
from merchantry.operators.explanations import explained
from merchantry.operators.recommendations import (
    apply_best_action, catalogue_table, profiles, scored, top_recommendation,
)
from merchantry.operators.rfm import lookup
from merchantry.operators.segments import priority_rank

TENANT = ["tenant_id"]


def commercial_value(category: Column) -> Column:
    """What acting on a customer is worth, by category."""
    revenue, aov, given = F.col("total_revenue"), F.col("aov"), F.col("total_discount_amount")
    # Shares of revenue.
    return (
        F.when(category == "protect_revenue", revenue)
        .when(category == "grow_revenue", F.when(aov > 0, aov).otherwise(revenue * 0.5))
        .when(category == "improve_margin", F.when(given > 0, given).otherwise(revenue * 0.1))
        .when(category == "strengthen_loyalty", revenue * 0.15)
        .otherwise(revenue * 0.1)
    )


# What the profile rewrites for its own use.
_REWRITTEN = ["segment", "net_revenue", "days_since_last_order", "avg_days_between_orders"]


def recommended(customers: DataFrame) -> DataFrame:
    """Customers with scores, best recommendation, texts and value; one narrow pass."""
    return explained(chosen(customers))


def chosen(customers: DataFrame) -> DataFrame:
    """H19 without the texts, which `explained` makes of these rows alone: to be stored, as texts are long.

    `_was` keeps the columns that the profile rewrites as they were stored.
    """
    kept = customers.withColumn("_was", F.struct(*[c for c in _REWRITTEN if c in customers.columns]))
    best = top_recommendation(scored(profiles(kept)))
    return best.withColumn("commercial_value", F.when(
        F.col("recommendation_id").isNotNull(), commercial_value(F.col("rec_category"))
    ))


def acted(best: DataFrame, customers: DataFrame) -> DataFrame:
    """`customers` with their best action, from what `recommended` made of them; nothing is scored again."""
    action_inputs = ["rec_title", "summary", "rec_priority", "rec_channel", "rec_timing"]
    stored = [F.col(f"_was.{c}").alias(c) if c in _REWRITTEN else F.col(c) for c in customers.columns]
    return apply_best_action(customers, best.select(*stored, *action_inputs))


def with_best_action(customers: DataFrame) -> DataFrame:
    """H13 over the stored customers; recency and revenue stay as stored."""
    return acted(recommended(customers), customers)


def plan_members(best: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One row per customer in the plan."""
    return best.where(F.col("recommendation_id").isNotNull()).select(
        *by, "customer_key", F.col("rec_category").alias("category"), "recommendation_id",
        F.col("rec_title").alias("action"), slug("rec_title").alias("action_key"),
        "commercial_value",
    )


def plan_actions(members: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Customers and value per recommendation."""
    grouped = members.groupBy(*by, "category", "recommendation_id").agg(
        F.count("*").alias("customer_count"),
        round_to(exact_sum("commercial_value"), 2).alias("estimated_commercial_value"),
    )
    texts = F.broadcast(
        catalogue_table(members.sparkSession).select(
            "recommendation_id", F.col("title").alias("action"), "priority",
            title_words("channel").alias("channel"), title_words("timing").alias("timing"),
            F.col("position").alias("catalogue_position"),
        )
    )
    return grouped.join(texts, "recommendation_id").withColumn(
        "section", lookup(F.col("category"), SECTIONS, "")
    ).withColumn("section_position", _section_position())


def _section_position() -> Column:
    pairs = [F.lit(x) for i, c in enumerate(SECTIONS) for x in (c, i + 1)]
    return F.create_map(*pairs)[F.col("category")]


def plan_totals(actions: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Section totals from the rounded action values, and the plan total (section null)."""
    out = actions.rollup(*by, "section_position", "section").agg(
        F.grouping_id().alias("_level"),
        F.sum("customer_count").alias("customer_count"),
        exact_sum("estimated_commercial_value", 2).alias("estimated_commercial_value"),
        F.count("*").alias("actions"),
    )
    return out.where(F.col("_level").isin(0, 3)).drop("_level")


def ordered_actions(actions: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Actions in plan order: by section, most customers first. At most 22 rows per plan."""
    order = Window.partitionBy(*by).orderBy("section_position", F.desc("customer_count"), "catalogue_position")
    return actions.withColumn("position", F.row_number().over(order))


def nested_plan(actions: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One row per plan with its sections and actions nested, members left long."""
    action = F.struct(
        F.col("position"), "recommendation_id", "action", "customer_count", "estimated_commercial_value", "channel",
        "timing",
    )
    sections = ordered_actions(actions, by).groupBy(*by, "section_position", "section", "category").agg(
        F.sum("customer_count").alias("customer_count"),
        exact_sum("estimated_commercial_value", 2).alias("estimated_commercial_value"),
        F.array_sort(F.collect_list(action)).alias("actions"),
    )
    section = F.struct(
        "section_position", "section", "category", "customer_count", "estimated_commercial_value", "actions"
    )
    return sections.groupBy(*by).agg(
        F.sum("customer_count").alias("total_customers"),
        exact_sum("estimated_commercial_value", 2).alias("total_commercial_value"),
        F.array_sort(F.collect_list(section)).alias("sections"),
    )


def action_groups(actions: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The plan as action groups, high priority first, then most customers."""
    order = Window.partitionBy(*by).orderBy(
        priority_rank(F.col("priority"), 2), F.desc("customer_count"), "section_position", "catalogue_position"
    )
    return actions.select(
        *by,
        F.row_number().over(order).alias("position"),
        "action",
        slug("action").alias("action_key"),
        F.col("priority").alias("action_priority"),
        "customer_count",
        F.col("estimated_commercial_value").alias("total_revenue_at_stake"),
        F.col("channel").alias("suggested_channel"),
        F.col("timing").alias("suggested_timing"),
    )


def plan_lines(actions: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The plan as numbered text lines."""
    def number(value: Column | str) -> Column:
        return (F.col(value) if isinstance(value, str) else value).cast("string")

    # Line patterns. A line is placed by (section, part, item, line).
    def line(section: Column, part: int, item: Column, sub: int, text: Column) -> Column:
        return F.struct(
            section.cast("int").alias("s"), F.lit(part).alias("p"), item.cast("int").alias("i"),
            F.lit(sub).alias("l"), text.alias("text"),
        )

    ordered = ordered_actions(actions, by)
    spot = F.col("section_position")
    action_lines = F.array(
        line(spot, 1, F.col("position"), 0, F.concat(
            F.lit("  • "), F.col("action"), F.lit(" — "), number("customer_count"), F.lit(" customer"),
            plural(F.col("customer_count")),
        )),
        line(spot, 1, F.col("position"), 1, F.concat(
            F.lit("    Estimated commercial value "), pounds("estimated_commercial_value")
        )),
    )
    totals = plan_totals(actions, by)
    zero, value = F.lit(0), pounds("estimated_commercial_value")
    section_lines = F.array(
        line(spot, 0, zero, 0, F.col("section")),
        line(spot, 2, zero, 0, F.concat(
            F.lit("  Section total: "), number("customer_count"), F.lit(" customers, "), value
        )),
        line(spot, 3, zero, 0, F.lit("")),
    )
    outer_lines = F.array(
        line(zero, 0, zero, 0, F.lit("Weekly Growth Plan")),
        line(zero, 0, zero, 1, F.repeat(F.lit("="), F.lit(40))),
        line(zero, 0, zero, 2, F.lit("")),
        line(F.lit(9), 0, zero, 0, F.concat(
            F.lit("Plan total: "), number("customer_count"), F.lit(" customers, "), value
        )),
    )
    lines = ordered.select(*by, F.inline(action_lines)).unionByName(
        totals.select(*by, F.inline(F.when(spot.isNull(), outer_lines).otherwise(section_lines)))
    )
    # A plan has at most 22 actions, so these windows stay short.
    order = Window.partitionBy(*by).orderBy("s", "p", "i", "l")
    return lines.select(*by, F.row_number().over(order).alias("line"), "text")
