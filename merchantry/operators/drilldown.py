"""Customer lists behind a segment, an action or an insight, and action state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.expressions import day_label, plural, round_to, slug
from merchantry.operators.order_statistics import in_list_order, top_rows
from merchantry.operators.segments import effective_segment

TENANT = ["tenant_id"]


def segment_customers(customers: DataFrame, segment: str | None = None, by: Sequence[str] = TENANT) -> DataFrame:
    """The customers of one segment, or of all; `position` runs by revenue, then key, in each segment."""
    rows = customers.withColumn("segment", effective_segment())
    if segment is not None:
        rows = rows.where(F.col("segment") == segment)
    rows = in_list_order(rows, [*by, "segment"], [F.desc("total_revenue"), F.asc("customer_key")])
    return rows.select(
        *by,
        F.col("customer_key").alias("email_or_id"),
        "segment",
        "position",
        "total_revenue",
        "order_count",
        day_label("last_order_date").alias("last_order_date"),
        "days_since_last_order",
        round_to("aov", 2).alias("aov"),
        "recommended_action",
        "action_reason",
        "action_priority",
    )


def action_customers(
    customers: DataFrame, members: DataFrame, action_key: str | None = None, by: Sequence[str] = TENANT
) -> DataFrame:
    """The plan's members of an action; an action without members falls back to
    the customers whose recommended action has that key."""
    keys = [*by, "customer_key"]
    planned = members.select(*keys, "action_key")
    named = customers.withColumn("action_key", slug("recommended_action"))
    if action_key is not None:
        planned = planned.where(F.col("action_key") == action_key)
        named = named.where(F.col("action_key") == action_key)
    covered = planned.join(customers.select(*keys), keys, "left_semi").select(*by, "action_key").distinct()
    from_plan = customers.join(planned.distinct(), keys)
    from_name = named.join(covered, [*by, "action_key"], "left_anti")
    both = from_plan.unionByName(from_name)
    return both.select(
        *by,
        "action_key",
        F.col("customer_key").alias("email_or_id"),
        "total_revenue",
        "order_count",
        day_label("last_order_date").alias("last_order_date"),
        F.col("action_reason").alias("reason"),
        F.col("suggested_channel").alias("channel"),
        F.col("suggested_timing").alias("timing"),
    )


def insight_customers(
    customers: DataFrame, members: DataFrame, insight_id: str, by: Sequence[str] = TENANT
) -> DataFrame:
    """The customers behind one insight."""
    keys = [*by, "customer_key"]
    wanted = members.where(F.col("insight_id") == insight_id).select(*keys)
    return customers.join(wanted, keys, "left_semi")


def top_customers_by_spend(customers: DataFrame, limit: int = 10, by: Sequence[str] = TENANT) -> DataFrame:
    """J4."""
    best = top_rows(customers, by, [F.desc("total_revenue"), F.asc("customer_key")], limit)
    return best.select(
        *by, "rank", F.col("customer_key").alias("email_or_id"), "total_revenue", "order_count",
        day_label("last_order_date").alias("last_order_date"), "days_since_last_order", "aov",
        "recommended_action", "action_priority",
    )


def _monitoring() -> Column:
    return F.lower("action").contains("monitor")


def open_actions(groups: DataFrame, priority: str | None = None) -> DataFrame:
    """Actions to take, without the monitoring ones; optionally of one priority."""
    rows = groups.where(~_monitoring())
    return rows if priority is None else rows.where(F.col("action_priority") == priority)


def monitoring_actions(groups: DataFrame) -> DataFrame:
    """The monitoring actions, which are shown apart."""
    return groups.where(_monitoring())


def apply_action_state(
    groups: DataFrame, state_log: DataFrame, current_upload: Column, by: Sequence[str] = TENANT
) -> DataFrame:
    """Hide actions snoozed for the current export, mark those done.

    The latest entry per action counts. `state_log` holds the group columns,
    `action_key`, `is_done`, `snoozed`, `snooze_upload_id`, `updated_at`.
    """
    keys = [*by, "action_key"]
    # An aggregate, not a ranked list: a log of any length is neither sorted nor sent, tasks send one entry per action.
    latest = state_log.groupBy(*keys).agg(
        F.max(F.struct("updated_at", "is_done", "snoozed", "snooze_upload_id")).alias("_last")
    ).select(*keys, "_last.is_done", "_last.snoozed", "_last.snooze_upload_id")
    snoozed = F.coalesce(F.col("snoozed"), F.lit(False)) & (
        F.col("snooze_upload_id").isNull()
        | (F.col("snooze_upload_id") == "")
        | (F.col("snooze_upload_id") == current_upload)
    )
    return (
        groups.join(latest, keys, "left")
        .where(~F.coalesce(snoozed, F.lit(False)))
        .withColumn("is_done", F.coalesce("is_done", F.lit(False)))
        .drop("snoozed", "snooze_upload_id")
    )


def shown(rows: DataFrame, limit: int, position: str = "position") -> DataFrame:
    """The first rows of a ranked list, as a page shows them."""
    return rows.where(F.col(position) <= limit)


def fallback_cards(groups: DataFrame, insights: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Insight cards made from actions, for groups without insights."""
    name, priority = F.lower("action"), F.col("action_priority")

    def has(*parts: str) -> Column:
        return F.greatest(*[name.contains(p) for p in parts]) if len(parts) > 1 else name.contains(parts[0])

    # Keywords, scores and texts.
    category = (
        F.when(has("lapsed", "win back", "re-engage"), "retention_risk")
        .when(has("new", "convert", "second"), "growth_opportunity")
        .when(has("discount"), "discount_inefficiency")
        .otherwise("growth_opportunity")
    )
    count = F.col("customer_count")
    return groups.join(insights.select(*by).distinct(), list(by), "left_anti").select(
        *by,
        F.concat(F.lit("fallback-"), (F.col("position") - 1).cast("string")).alias("insight_id"),
        category.alias("category"),
        F.col("action").alias("headline"),
        F.concat(
            count.cast("string"), F.lit(" customer"), plural(count), F.lit(" need"),
            F.when(count == 1, "s").otherwise(""), F.lit(" this action. Best channel: "), F.col("suggested_channel"),
            F.lit(". Timing: "), F.col("suggested_timing"), F.lit("."),
        ).alias("explanation"),
        F.col("total_revenue_at_stake").alias("revenue_at_stake"),
        count.alias("affected_count"),
        F.when(priority.isin("high", "medium"), priority).otherwise("low").alias("confidence"),
        F.concat(
            F.col("action"), F.lit(" via "), F.col("suggested_channel"), F.lit(". "), F.col("suggested_timing"), F.lit(".")
        ).alias("suggested_action"),
        F.when(priority == "high", 80.0).when(priority == "medium", 50.0).otherwise(20.0).alias("score"),
    )
