"""Customer 360: one row per customer, behavioural flags, segment and next action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.config import RULES, Rules
from merchantry.functions.expressions import blank, floor_days, safe_div, time_of_day, whole
from merchantry.operators.headline import customer_column
from merchantry.operators.order_statistics import quantiles
from merchantry.session import store

TENANT = ["tenant_id"]

# Segment names by first matching rule, see `segment_rule`.
SEGMENTS = ["Lapsed", "VIPs", "Going Quiet", "New Customers", "One-Time Buyers", "Discount Shoppers", "Regulars"]


def keyed_rows(sales: DataFrame) -> DataFrame:
    """Rows with a customer, keyed by `customer_key`."""
    key = customer_column(sales.columns)
    if key is None:
        raise ValueError("no customer column")
    return sales.where(~blank(key)).withColumn("customer_key", F.col(key).cast("string"))


def skipped_rows(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Rows kept and rows skipped for want of a customer."""
    missing = blank(customer_column(sales.columns))
    return sales.groupBy(*by).agg(
        F.count_if(~missing).alias("kept_rows"), F.count_if(missing).alias("skipped_rows")
    )


def _totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, distinct orders and first and last date."""
    columns = set(rows.columns)
    aggregates = []
    if "total" in columns:
        aggregates.append(F.coalesce(F.sum("total").cast("double"), F.lit(0.0)).alias("total_revenue"))
    if "order_id" in columns:
        aggregates.append(F.countDistinct("order_id").alias("order_count"))
    elif "total" in columns:
        aggregates.append(F.count("total").alias("order_count"))
    if "order_date" in columns:
        aggregates += [F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date")]
    if "quantity" in columns:
        aggregates.append(F.sum("quantity").alias("total_quantity_purchased"))
    if "discount_amount" in columns:
        aggregates.append(F.coalesce(F.sum("discount_amount").cast("double"), F.lit(0.0)).alias("total_discount_amount"))
        aggregates.append(F.count_if(F.col("discount_amount") > 0).alias("_discounted_rows"))
    if "refund_amount" in columns:
        aggregates.append(F.coalesce(F.sum("refund_amount").cast("double"), F.lit(0.0)).alias("refund_total"))
    out = rows.groupBy(*keys).agg(*aggregates)
    absent = {
        "total_revenue": F.lit(0.0),
        "order_count": F.lit(1).cast("bigint"),
        "total_discount_amount": F.lit(0.0),
        "_discounted_rows": F.lit(0).cast("bigint"),
        "refund_total": F.lit(0.0),
        "first_order_date": F.lit(None).cast("timestamp_ntz"),
        "last_order_date": F.lit(None).cast("timestamp_ntz"),
        "total_quantity_purchased": F.lit(0.0),
    }
    return out.withColumns({name: value for name, value in absent.items() if name not in out.columns})


def order_gaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean whole-day gap between consecutive distinct order times, -1 below two.

    A gap in whole days is the difference of the dates, less one where the later
    time of day is the earlier one. Inside one day that never happens, so a day
    needs only its first and last time, and even a customer with a very large
    number of orders is reduced to one row per day before being ordered.
    """
    days = (
        rows.where(F.col("order_date").isNotNull())
        .groupBy(*keys, F.col("order_date").cast("date").alias("_day"))
        .agg(
            F.min("order_date").alias("_open"),
            F.max("order_date").alias("_close"),
            F.countDistinct("order_date").alias("_times"),
        )
    )
    return gaps_of_days(days, keys)


def gaps_of_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G7 from one row per customer and day: its first and last time (`_open`, `_close`) and number of times."""
    previous = F.lag("_close").over(Window.partitionBy(*keys).orderBy("_day"))
    borrowed = F.when(time_of_day(F.col("_open")) < time_of_day(previous), 1).otherwise(0)
    return (
        days.withColumn("_borrowed", borrowed)
        .groupBy(*keys)
        .agg(
            F.datediff(F.max("_day"), F.min("_day")).alias("_span"),
            F.sum("_borrowed").alias("_borrowed"),
            F.sum("_times").alias("_times"),
        )
        .select(
            *keys,
            F.when(
                F.col("_times") >= 2,
                (F.col("_span") - F.col("_borrowed")).cast("double") / (F.col("_times") - 1),
            )
            .otherwise(-1.0)
            .alias("avg_days_between_orders"),
        )
    )


def product_preferences(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First product, most-bought product, distinct products.

    Ties: the first product in name order.
    """
    first_date = F.min("order_date") if "order_date" in rows.columns else F.lit(None).cast("timestamp_ntz")
    per_product = (
        rows.where(F.col("product_name").isNotNull())
        .groupBy(*keys, "product_name")
        .agg(F.count("*").alias("_count"), first_date.alias("_first"))
    )
    return preferences_of(per_product, keys, "order_date" in rows.columns)


def preferences_of(per_product: DataFrame, keys: Sequence[str], with_dates: bool = True) -> DataFrame:
    """G8, G9 from one row per customer and product: its number of rows (`_count`) and first date."""
    dated = F.col("_first").isNotNull() if with_dates else F.lit(True)
    return per_product.groupBy(*keys).agg(
        F.count("*").alias("distinct_products_purchased"),
        F.min(F.when(dated, F.struct("_first", "product_name")))["product_name"].alias("first_product_purchased"),
        F.min(F.struct(-F.col("_count"), "product_name"))["product_name"].alias("most_bought_product"),
    )


def customer_base(sales: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """G2–G9 without recency: one row per customer, before any group figure is known."""
    rows = keyed_rows(sales)
    keys = [*by, "customer_key"]
    columns = set(rows.columns)
    base = _totals(rows, keys)
    if {"order_date", "order_id"} <= columns:
        base = base.join(order_gaps(rows, keys), keys, "left")
    else:
        base = base.withColumn("avg_days_between_orders", F.lit(-1.0))
    if "product_name" in columns:
        base = base.join(product_preferences(rows, keys), keys, "left")
    else:
        base = base.withColumns({
            "distinct_products_purchased": F.lit(None).cast("bigint"),
            "first_product_purchased": F.lit(None).cast("string"),
            "most_bought_product": F.lit(None).cast("string"),
        })
    return with_ratios(base, "order_date" in columns)


def with_ratios(base: DataFrame, with_dates: bool = True) -> DataFrame:
    """G3, G5, G6 and lifetime from a customer's totals, gaps and products."""
    lifetime = F.coalesce(
        floor_days(F.col("last_order_date"), F.col("first_order_date")).cast("bigint"),
        F.lit(0 if with_dates else -1),
    )
    frequency = safe_div("order_count", F.greatest(F.col("customer_lifetime_days"), F.lit(1)) / F.lit(30.0))
    return (
        base.withColumn("avg_days_between_orders", F.coalesce("avg_days_between_orders", F.lit(-1.0)))
        .withColumn("aov", safe_div("total_revenue", "order_count"))
        .withColumn("customer_lifetime_days", lifetime)
        .withColumn("purchase_frequency", frequency if with_dates else F.lit(0.0))
        .withColumn("discount_usage_rate", safe_div("_discounted_rows", "order_count"))
        .withColumn(
            "net_revenue",
            (F.col("total_revenue").cast("decimal(38,4)") - F.col("refund_total").cast("decimal(38,4)")).cast("double"),
        )
        .drop("_discounted_rows")
    )


def group_figures(
    customers: DataFrame, by: Sequence[str] = TENANT, as_of: Column | None = None, rules: Rules = RULES
) -> DataFrame:
    """Per group its size, reference date and high-value threshold.

    The reference date is the day of the last order, but not after `as_of`.
    """
    last = F.max(F.col("last_order_date").cast("date"))
    cap = as_of.cast("date") if as_of is not None else None
    reference = last if cap is None else F.coalesce(F.least(cap, last), cap)
    dates = customers.groupBy(*by).agg(
        F.count("*").alias("customers"), reference.cast("timestamp_ntz").alias("reference_date")
    )
    tops = quantiles(customers, by, "total_revenue", {"_top": rules.high_value_quantile}).drop("n")
    return dates.join(tops, list(by), "left").withColumn(
        "high_value_from",
        F.when(F.col("customers") < rules.high_value_min_customers, 0.0).otherwise(F.col("_top")),
    ).drop("_top")


def recency(last: Column, reference: Column) -> Column:
    return F.coalesce(floor_days(reference, last).cast("bigint"), F.lit(-1).cast("bigint"))


def at_risk(rules: Rules = RULES) -> Column:
    """Overdue by more than twice the customer's own gap."""
    gap, days = F.col("avg_days_between_orders"), F.col("days_since_last_order")
    return (F.col("order_count") >= 2) & (gap > 0) & (days >= 0) & (days > rules.at_risk_gap_multiple * gap)


def with_flags(customers: DataFrame, rules: Rules = RULES) -> DataFrame:
    """G11, except the return risk: flags from recency, orders, discounts, revenue."""
    orders, days = F.col("order_count"), F.col("days_since_last_order")
    return customers.withColumns({
        "is_repeat_customer": orders >= 2,
        "is_one_time_buyer": orders == 1,
        "is_lapsed": days >= rules.lapsed_days,
        "is_discount_dependent": F.col("discount_usage_rate") > rules.discount_dependent_rate,
        "is_full_price_loyal": (orders >= 2) & (F.col("discount_usage_rate") == 0),
        "is_high_value": F.col("total_revenue") >= F.col("high_value_from"),
        "is_new_customer": (days >= 0) & (days <= rules.new_days),
        "is_at_risk": at_risk(rules),
    })


def segment_rule() -> Column:
    """The first rule that matches."""
    return (
        F.when(F.col("is_lapsed"), "Lapsed")
        .when(F.col("is_high_value") & F.col("is_full_price_loyal"), "VIPs")
        .when(F.col("is_at_risk"), "Going Quiet")
        .when(F.col("is_new_customer"), "New Customers")
        .when(F.col("is_one_time_buyer"), "One-Time Buyers")
        .when(F.col("is_discount_dependent"), "Discount Shoppers")
        .otherwise("Regulars")
    )


def second_purchase_window(days: Column | None = None, rules: Rules = RULES) -> Column:
    days = F.col("days_since_last_order") if days is None else days
    return F.col("is_one_time_buyer") & days.between(rules.window_from_days, rules.window_to_days)


def baseline_action() -> Column:
    """Action, reason, priority, channel and timing by the first rule that matches."""
    days = F.col("days_since_last_order").cast("string")
    orders = F.col("order_count").cast("string")
    rate = whole(F.col("discount_usage_rate") * 100).cast("string")

    def act(action: str, reason: Column, priority: str, channel: str, timing: str) -> Column:
        return F.struct(
            F.lit(action).alias("recommended_action"),
            reason.alias("action_reason"),
            F.lit(priority).alias("action_priority"),
            F.lit(channel).alias("suggested_channel"),
            F.lit(timing).alias("suggested_timing"),
        )

    # Action texts.
    return (
        F.when(
            F.col("is_lapsed") & F.col("is_high_value"),
            act(
                "Personal re-engagement — call, don't email",
                F.concat(
                    F.lit("No purchase in "), days,
                    F.lit(" days and in top 20% by revenue. High-value lapsed customers need a personal touch."),
                ),
                "high", "Personal outreach", "Immediately",
            ),
        )
        .when(
            F.col("is_at_risk") & F.col("is_high_value"),
            act(
                "Send win-back email — offer genuine incentive",
                F.concat(
                    F.lit("Last order "), days,
                    F.lit(" days ago — more than 2× their usual gap. High value. Act before they lapse."),
                ),
                "high", "Email", "This week",
            ),
        )
        .when(
            F.col("is_full_price_loyal"),
            act(
                "Add to VIP audience — no discount needed",
                F.concat(
                    orders,
                    F.lit(" orders at full price, zero discounts used. Protect margin — keep them off discount lists."),
                ),
                "medium", "Email / Ads", "This month",
            ),
        )
        .when(
            F.col("is_new_customer"),
            act(
                "Send onboarding sequence",
                F.concat(
                    F.lit("First purchase "), days,
                    F.lit(" days ago. Early nurture is critical for long-term retention."),
                ),
                "medium", "Email", "This week",
            ),
        )
        .when(
            second_purchase_window(),
            act(
                "Send second-purchase nudge",
                F.concat(
                    F.lit("One purchase "), days,
                    F.lit(" days ago — the 30–60 day window is the best time to convert to repeat buyer."),
                ),
                "medium", "Email", "This week",
            ),
        )
        .when(
            F.col("is_discount_dependent"),
            act(
                "Test at full price — may buy anyway",
                F.concat(
                    rate, F.lit("% of orders used a discount. Worth testing removal — they may buy regardless."),
                ),
                "low", "Email / Ads", "Next campaign",
            ),
        )
        .otherwise(
            act(
                "Monitor — no immediate action",
                F.lit("No strong behavioural signal. Keep in regular communications."),
                "low", "Regular comms", "Ongoing",
            )
        )
    )


def customer360(
    sales: DataFrame, by: Sequence[str] = TENANT, as_of: Column | None = None, rules: Rules = RULES
) -> DataFrame:
    """The customer table: totals, recency, nine flags, segment and baseline action."""
    return finished_customers(store(customer_base(sales, by), "customer-base"), by, as_of, rules)


def finished_customers(
    base: DataFrame, by: Sequence[str] = TENANT, as_of: Column | None = None, rules: Rules = RULES
) -> DataFrame:
    """The customer table from its stored base: what depends on the group's own figures."""
    figures = store(group_figures(base, by, as_of, rules), "customer-figures")
    today = F.col("reference_date")
    customers = base.join(figures.drop("customers"), list(by)).withColumn(
        "days_since_last_order", recency(F.col("last_order_date"), today)
    )
    flagged = with_flags(customers, rules).withColumn(
        "is_high_return_risk", safe_div("refund_total", "total_revenue") > rules.return_risk_rate
    )
    return (
        flagged.withColumn("segment", segment_rule())
        .withColumn("_action", baseline_action())
        .select("*", "_action.*")
        .drop("_action", "high_value_from")
    )


# What a stored customer row is taken to hold where a column is missing.
STORED_DEFAULTS = {
    "total_revenue": 0.0, "order_count": 0, "discount_usage_rate": 0.0, "avg_days_between_orders": -1.0,
}


def refresh_flags(
    stored: DataFrame, by: Sequence[str] = TENANT, as_of: Column | None = None, rules: Rules = RULES
) -> DataFrame:
    """Recompute recency, flags and segment of stored customers.

    Return risk and actions stay as stored.
    """
    customers = stored.drop("reference_date")
    for name, default in STORED_DEFAULTS.items():
        kind = "bigint" if isinstance(default, int) else "double"
        value = F.col(name).cast(kind) if name in customers.columns else F.lit(None).cast(kind)
        customers = customers.withColumn(name, F.coalesce(value, F.lit(default).cast(kind)))
    dated = "last_order_date" in customers.columns
    if not dated:
        customers = customers.withColumn("last_order_date", F.lit(None).cast("timestamp_ntz"))
    figures = store(group_figures(customers, by, as_of, rules), "refresh-figures").drop("customers")
    joined = customers.join(figures, list(by))
    if dated or "days_since_last_order" not in joined.columns:
        joined = joined.withColumn("days_since_last_order", recency(F.col("last_order_date"), F.col("reference_date")))
    return with_flags(joined, rules).withColumn("segment", segment_rule()).drop("high_value_from")
