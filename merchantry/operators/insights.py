"""Portfolio insights: eleven rules over the customer table, their members and texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.config import RULES
from merchantry.functions.expressions import exact_sum, pounds, round_to, safe_div
from merchantry.operators.catalogue import PORTFOLIO_TRIGGERS
from merchantry.operators.customers import second_purchase_window
from merchantry.operators.order_statistics import keys_at, top_rows, values_at
from merchantry.session import store

TENANT = ["tenant_id"]

# Score weights.
CONFIDENCE_SCORE = {"high": 1.0, "medium": 0.7, "low": 0.4}
TIMING_SCORE = {"immediately": 1.0, "this week": 1.0, "this month": 0.7, "next campaign": 0.5, "ongoing": 0.3}

MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
]


def _top_value(customers: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """Per group: the most frequent value, its customers, and how many values there are.

    Ties go to the smallest value.
    """
    counted = customers.where(value.isNotNull()).groupBy(*by, value.alias("_value")).agg(F.count("*").alias("_count"))
    best = F.min(F.struct((-F.col("_count")).alias("c"), F.col("_value").alias("v")))
    return counted.groupBy(*by).agg(
        best["v"].alias(f"top_{name}"), (-best["c"]).alias(f"top_{name}_customers"),
        F.count("*").alias(f"{name}_values"), F.sum("_count").alias(f"{name}_known"),
    )


def group_marks(customers: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """What a rule must know about the whole group before it looks at a customer."""
    by = list(by)
    middle, decile = (F.col("n") - 1) / 2, F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    found = store(values_at(customers, by, "total_revenue", {
        "decile": (0.9, F.col("n") - decile + 1), "mid_a": (0.5, F.floor(middle) + 1), "mid_b": (0.5, F.ceil(middle) + 1),
    }), "revenue-marks")
    # Customers of one revenue are in the order of their keys, the best first.
    larger = F.col("n") - F.col("smaller") - F.col("equal")
    last = keys_at(
        customers, by, "total_revenue", "customer_key",
        found.where("label = 'decile'").select(*by, "label", "value", (decile - larger).alias("rank")),
    ).select(*by, F.col("customer_key").alias("decile_key"))

    def at(label: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col("value")))

    cuts = found.groupBy(*by).agg(
        F.max(decile).alias("decile_size"), at("decile").alias("decile_revenue"),
        round_to((at("mid_a") + at("mid_b")) / 2, 4).alias("median_revenue"),
    ).join(last, by)
    means = customers.groupBy(*by).agg(
        F.count("*").alias("customers"), safe_div(exact_sum("aov"), F.count("*")).alias("mean_aov"),
        exact_sum("total_revenue", 4).alias("all_revenue"),
    )
    products = _top_value(customers, by, F.col("most_bought_product"), "product")
    months = _top_value(customers, by, F.month(F.col("last_order_date").cast("date")), "month")
    return store(
        means.join(cuts, by).join(products, by, "left").join(months, by, "left"), "group-marks"
    )


def _in_decile() -> Column:
    revenue, cut = F.col("total_revenue"), F.col("decile_revenue")
    return (revenue > cut) | ((revenue == cut) & (F.col("customer_key") <= F.col("decile_key")))


def member_conditions() -> dict[str, Column]:
    """Which customers an insight is about. The repeat-rate rule lists none."""
    return {
        "retention-lapsed-high-value": F.col("is_lapsed") & F.col("is_high_value"),
        "retention-at-risk-high-value": F.col("is_at_risk") & F.col("is_high_value") & ~F.col("is_lapsed"),
        "retention-overall-lapse-rate": F.col("is_lapsed"),
        "growth-first-to-second-window": second_purchase_window(),
        "growth-full-price-loyalists": F.col("is_full_price_loyal") & F.col("is_repeat_customer"),
        "discount-dependency": F.col("is_discount_dependent"),
        "cohort-new-customer-quality": F.col("is_new_customer"),
        "concentration-top10pct": _in_decile(),
        "concentration-product": F.col("most_bought_product") == F.col("top_product"),
        "seasonality-peak-month": F.month(F.col("last_order_date").cast("date")) == F.col("top_month"),
    }


def marked_customers(customers: DataFrame, marks: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    return customers.join(marks, list(by))


def portfolio(customers: DataFrame, marks: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One wide row per group: for every rule its customers, revenue and discounts."""
    columns: list[Column] = []
    for i, condition in enumerate(member_conditions().values()):
        hit = F.coalesce(condition, F.lit(False))
        revenue = F.when(hit, F.col("total_revenue")).otherwise(0.0)
        columns += [F.count_if(hit).alias(f"_n{i}"), exact_sum(revenue, 4).alias(f"_rev{i}")]
    new = F.col("is_new_customer")
    columns += [
        F.count_if("is_repeat_customer").alias("repeat_customers"),
        F.count_if(new).alias("new_customers"),
        exact_sum(F.when(new, F.col("aov")).otherwise(0.0)).alias("_new_aov"),
        exact_sum(F.when(F.col("is_discount_dependent"), F.col("total_discount_amount")).otherwise(0.0), 4).alias("_discounts"),
    ]
    wide = marked_customers(customers, marks, by).groupBy(*by).agg(*columns)
    return wide.join(marks, list(by)).withColumn("new_mean_aov", safe_div("_new_aov", "new_customers"))


def confidence_of(n: Column) -> Column:
    """I12."""
    return F.when(n >= 10, "high").when(n >= 4, "medium").otherwise("low")


def _from(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def insight_score(confidence: Column, stake: Column, total: Column, timing: str) -> Column:
    """Confidence, share of revenue and urgency, out of 100."""
    share = F.least(stake / F.greatest(total, F.lit(1.0)), F.lit(1.0))
    return round_to(_from(CONFIDENCE_SCORE, confidence) * 40 + share * 40 + F.lit(TIMING_SCORE[timing]) * 20, 2)


def _decimals(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def insights(wide: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The insights that fire, scored, ranked and worded."""
    index = {name: i for i, name in enumerate(member_conditions())}
    customers, total = F.col("customers"), F.col("all_revenue")

    def n_of(name: str) -> Column:
        return F.col(f"_n{index[name]}")

    def rev_of(name: str) -> Column:
        return F.col(f"_rev{index[name]}")

    def text(value: Column) -> Column:
        return value.cast("string")

    entries: list[Column] = []

    def add(
        id: str, category: str, timing: str, fires: Column, stake: Column, affected: Column, headline: Column,
        explanation: Column, action: Column | str, data_logic: Column, flags: list[str], confidence: Column | None = None,
    ) -> None:
        sure = confidence_of(affected) if confidence is None else confidence
        entries.append(F.when(
            fires & (total > 0),
            F.struct(
                F.lit(len(entries) + 1).alias("rule"), F.lit(id).alias("insight_id"), F.lit(category).alias("category"),
                headline.alias("headline"), explanation.alias("explanation"),
                round_to(stake, 2).alias("revenue_at_stake"), affected.cast("bigint").alias("affected_count"),
                sure.alias("confidence"), (F.lit(action) if isinstance(action, str) else action).alias("suggested_action"),
                F.lit(",".join(flags)).alias("flag_citations"), data_logic.alias("data_logic"),
                insight_score(sure, stake, total, timing).alias("score"),
            ),
        ))

    # Texts and thresholds of the rules, in rule order.
    name = "retention-lapsed-high-value"
    n, rev = n_of(name), rev_of(name)
    add(
        name, "retention_risk", "immediately", n > 0, rev, n,
        _concat("High-value customers have gone cold — ", text(n), " lapsed buyers"),
        _concat(text(n), " of your most valuable customers haven't purchased in 180+ days. These aren't cold leads — "
                "they're people who already chose your brand. A personal outreach (not a broadcast email) is the "
                "highest-ROI move here."),
        "Send a personal re-engagement message referencing their last purchase. No discount — just a check-in.",
        _concat("Identified ", text(n), " customers with is_lapsed=True (last order ≥ 180 days ago) AND "
                "is_high_value=True (revenue in top 20% of base). Combined revenue at stake: ", pounds(rev), "."),
        ["is_lapsed", "is_high_value"],
    )

    name = "retention-at-risk-high-value"
    n, rev = n_of(name), rev_of(name)
    add(
        name, "retention_risk", "this week", n > 0, rev, n,
        _concat("Win-back window open — ", text(n), " valuable buyers overdue"),
        _concat(text(n), " customers who spend above average have gone past 2× their usual buying gap. They're not "
                "gone yet, but they're cooling. A targeted email this week — before they tip into lapsed — is your "
                "best recovery chance."),
        "Send a win-back email referencing their last product. Offer a genuine incentive — not a blanket 10% off.",
        _concat("Identified ", text(n), " customers with is_at_risk=True (days_since_last_order > 2 × "
                "avg_days_between_orders) AND is_high_value=True. Excludes already-lapsed customers."),
        ["is_at_risk", "is_high_value"],
    )

    name = "retention-overall-lapse-rate"
    n, rev = n_of(name), rev_of(name)
    share = n / customers * 100
    add(
        name, "retention_risk", "this month", (share > 15) & (n >= 5), rev, n,
        _concat(_decimals(share, 0), "% of your customer base has lapsed — above healthy levels"),
        _concat(text(n), " of your ", text(customers), " customers haven't bought in 180+ days. A healthy brand should "
                "keep this below 15%. Yours is at ", _decimals(share, 0), "%. This is a systemic retention problem, not "
                "just individual customer churn."),
        "Segment lapsed customers by value — high-value get personal outreach, mid-value get a win-back sequence, "
        "low-value get a re-permission email.",
        _concat(text(n), " customers flagged is_lapsed=True out of ", text(customers), " total. Lapse rate: ",
                _decimals(share, 1), "%. Industry benchmark: <15%."),
        ["is_lapsed"],
    )

    name = "growth-first-to-second-window"
    n, rev = n_of(name), rev_of(name)
    add(
        name, "growth_opportunity", "this week", n > 0, rev * 1.2, n,
        _concat("Conversion window closing — ", text(n), " one-time buyers need a nudge now"),
        _concat(text(n), " customers made their first purchase 30–60 days ago and haven't returned. This window is "
                "statistically the best time to convert them — after 60 days, the chances drop sharply. A single "
                "well-timed email referencing their purchase can double your conversion rate."),
        "Send a second-purchase nudge referencing their first product. Include social proof or a bestseller "
        "recommendation.",
        _concat("Customers with is_one_time_buyer=True and 30 ≤ days_since_last_order ≤ 60. Count: ", text(n),
                ". Revenue if converted at same AOV: estimate ", pounds(rev * 0.9), "."),
        ["is_one_time_buyer", "days_since_last_order"],
    )

    name = "growth-full-price-loyalists"
    n, rev = n_of(name), rev_of(name)
    share = n / customers * 100
    add(
        name, "growth_opportunity", "immediately", n > 0, rev, n,
        _concat(text(n), " full-price loyalists — your highest-margin customers"),
        _concat(text(n), " repeat customers have never used a discount (", _decimals(share, 0), "% of your base). These "
                "people buy at full price, repeatedly. They're your most margin-efficient customers. Putting them in a "
                "promotion list trains them to wait for sales — exclude them from every campaign."),
        "Tag these customers and exclude them from ALL discount campaigns. Reward with exclusive access, not price cuts.",
        _concat("Customers with is_full_price_loyal=True (order_count ≥ 2 AND discount_usage_rate = 0). Count: ", text(n),
                " (", _decimals(share, 1), "% of base). Total revenue: ", pounds(rev), "."),
        ["is_full_price_loyal", "is_repeat_customer"],
    )

    name = "discount-dependency"
    n, given = n_of(name), F.col("_discounts")
    share = n / customers * 100
    add(
        name, "discount_inefficiency", "next campaign", n > 0, given, n,
        _concat(text(n), " customers (", _decimals(share, 0), "%) are discount-dependent — margin is leaking"),
        _concat(text(n), " customers used a discount on more than 70% of their orders. You've given away ", pounds(given),
                " in discounts to this group. Some of them would buy at full price — you won't know until you test."),
        "Remove this group from your next promotion. Monitor: those who still buy are full-price convertibles. Those "
        "who don't — that's their real LTV.",
        _concat("Customers with discount_usage_rate > 0.70 (70%+ of orders used a discount). Count: ", text(n),
                ". Total discounts given: ", pounds(given), "."),
        ["is_discount_dependent", "discount_usage_rate", "total_discount_amount"],
    )

    repeat = F.col("repeat_customers")
    share = repeat / customers * 100
    add(
        "cohort-low-repeat-rate", "cohort_quality", "this month", (customers >= 5) & (share < 30), F.lit(0.0),
        customers - repeat,
        _concat("Only ", _decimals(share, 0), "% of customers have bought more than once"),
        _concat(text(repeat), " of your ", text(customers), " customers have placed 2+ orders. A healthy brand should "
                "see 30–50% repeat rate. Yours is below that. Every customer you acquire but don't retain costs you "
                "twice — once to get them, once when they leave."),
        "Audit your post-purchase flow. If there's no automated second-purchase sequence, build one — it's the single "
        "highest-ROI retention tool.",
        _concat("repeat_rate = ", text(repeat), " customers with order_count ≥ 2 / ", text(customers), " total = ",
                _decimals(share, 1), "%. Industry benchmark for healthy retention: 30–50%."),
        ["is_repeat_customer"],
        F.when(customers >= 20, "high").otherwise("medium"),
    )

    name = "cohort-new-customer-quality"
    n, rev = n_of(name), rev_of(name)
    fresh, usual = F.col("new_mean_aov"), F.col("mean_aov")
    premium = (F.try_divide(fresh, usual) - 1) * 100
    add(
        name, "cohort_quality", "immediately", (customers >= 5) & (n >= 3) & (fresh > usual * 1.1), rev, n,
        _concat("New customers are spending ", _decimals(premium, 0), "% more than your average"),
        _concat("Your ", text(n), " new customers (last 30 days) have an average order value of £", _decimals(fresh, 0),
                " vs your overall AOV of £", _decimals(usual, 0), ". This is a quality signal — your current acquisition "
                "channels are bringing in higher-value buyers. Double down on whatever is driving this."),
        "Identify which channel these new customers came from and increase spend there. Also: make sure your "
        "onboarding sequence treats them as high-value from day one.",
        _concat("New customer (is_new_customer=True) avg AOV: £", _decimals(fresh, 2), ". Overall AOV: £",
                _decimals(usual, 2), ". Delta: +", _decimals(premium, 1), "%."),
        ["is_new_customer", "aov"],
    )

    name = "concentration-top10pct"
    n, rev = F.col("decile_size"), rev_of(name)
    share = F.try_divide(rev, total) * 100
    add(
        name, "customer_concentration", "this month", (customers >= 10) & (share > 50), rev, n,
        _concat("Top ", text(n), " customers drive ", _decimals(share, 0), "% of your revenue — concentration risk"),
        _concat("Your top 10% of customers (", text(n), " people) account for ", _decimals(share, 0), "% of total revenue. "
                "This level of concentration means losing a handful of VIPs could materially hurt your business. It also "
                "means your mid-tier customers have significant untapped potential."),
        "Protect your top customers with a dedicated VIP program. Simultaneously, run second-purchase campaigns for your "
        "mid-tier to diversify your revenue base.",
        _concat("Top ", text(n), " customers by total_revenue (top 10%). Their combined revenue: ", pounds(rev), " = ",
                _decimals(share, 1), "% of total ", pounds(total), "."),
        ["total_revenue", "is_high_value"],
        F.lit("high"),
    )

    name = "concentration-product"
    n, rev, product = n_of(name), rev_of(name), F.col("top_product")
    share = n / customers * 100
    add(
        name, "product_concentration", "this month",
        (F.coalesce("product_values", F.lit(0)) >= 2) & (share > 40), rev, n,
        _concat("'", product, "' is the most-bought item for ", _decimals(share, 0), "% of your customers"),
        _concat(text(n), " of your customers (", _decimals(share, 0), "%) most frequently purchased '", product, "'. This "
                "level of product concentration is a risk: if that product goes out of stock, changes pricing, or loses "
                "relevance, it could drive significant churn. It's also a cross-sell opportunity."),
        _concat("Cross-sell complementary items to buyers of '", product, "'. Also: make sure this product is always in "
                "stock and treated as your anchor product."),
        _concat(text(n), " customers have '", product, "' as their most-bought product (", _decimals(share, 1),
                "% of base). Total revenue from this group: est. ", pounds(rev), "."),
        ["most_bought_product"],
    )

    name = "seasonality-peak-month"
    n, rev, dated = n_of(name), rev_of(name), F.col("month_known")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.coalesce("top_month", F.lit(1)))
    share = F.try_divide(n, dated) * 100
    add(
        name, "seasonality", "this month", (F.coalesce(dated, F.lit(0)) >= 10) & (share > 30), rev, n,
        _concat(month, " is your biggest buying month — ", _decimals(share, 0), "% of orders land then"),
        _concat(text(n), " of your customers made their most recent purchase in ", month, " (", _decimals(share, 0),
                "% of your active base). This level of seasonal concentration means you're heavily dependent on one "
                "period — revenue will dip sharply in other months unless you actively drive off-peak purchases."),
        _concat("Build an off-peak campaign for the months immediately before and after ", month, ". Consider a 'between "
                "seasons' product launch to flatten the revenue curve."),
        _concat("Distribution of last_order_date by month across ", text(dated), " customers with dates. Top month: ",
                month, " with ", text(n), " customers (", _decimals(share, 1), "%)."),
        ["last_order_date"],
    )

    fired = wide.select(*by, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_insight"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("rule"))  # at most eleven rows
    return (
        fired.select(*by, "_insight.*")
        .withColumn("position", F.row_number().over(order))
        .drop("rule")
    )


def insight_members(
    customers: DataFrame, marks: DataFrame, fired: DataFrame, by: Sequence[str] = TENANT
) -> DataFrame:
    """Every customer behind each insight that fired."""
    hits = F.array(*[
        F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in member_conditions().items()
    ])
    listed = marked_customers(customers, marks, by).select(
        *by, "customer_key", "total_revenue", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("insight_id")
    )
    return listed.join(fired.select(*by, "insight_id"), [*by, "insight_id"], "left_semi")


def listed_members(members: DataFrame, limit: int, by: Sequence[str] = TENANT) -> DataFrame:
    """The first keys of an insight for a screen: by key, for revenue concentration by revenue. Exports take all members."""
    by_revenue = F.when(F.col("insight_id") == "concentration-top10pct", -F.col("total_revenue")).otherwise(0.0)
    shown = top_rows(members, [*by, "insight_id"], [by_revenue, F.asc("customer_key")], limit)
    return shown.select(*by, "insight_id", "rank", "customer_key")


def portfolio_metrics(customers: DataFrame, marks: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The named metrics of each group, one column per metric."""
    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    flag: Callable[[str], Column] = F.col
    c = marked_customers(customers, marks, by)
    new = flag("is_new_customer")
    counted = c.groupBy(*by).agg(
        count(flag("is_lapsed") & flag("is_high_value")).alias("lapsed_high_value_count"),
        count(flag("is_at_risk") & flag("is_high_value") & ~flag("is_lapsed")).alias("at_risk_high_value_count"),
        count(flag("is_lapsed")).alias("lapsed_count"),
        count(flag("segment") == "Going Quiet").alias("_quiet"),
        count(second_purchase_window()).alias("one_time_buyer_30_60_count"),
        count(flag("is_at_risk")).alias("at_risk_count"),
        count(new).alias("new_customer_count"),
        count(flag("is_discount_dependent")).alias("discount_dependent_count"),
        count(flag("is_full_price_loyal") & flag("is_repeat_customer")).alias("full_price_loyalist_count"),
        count(flag("segment") == "VIPs").alias("_vips"),
        count((flag("order_count") >= 4) & flag("is_full_price_loyal") & flag("is_high_value")).alias("champion_count"),
        count(flag("distinct_products_purchased") == 1).alias("_single"),
        count(flag("is_repeat_customer") & (flag("aov") < flag("mean_aov"))).alias("low_aov_repeat_count"),
        count(
            (flag("segment") == "Regulars") & (flag("order_count") >= 3) & (flag("total_revenue") > flag("median_revenue"))
        ).alias("regulars_ready_for_vip_count"),
        count(flag("is_high_return_risk")).alias("high_return_risk_count"),
        count(new & flag("is_high_return_risk")).alias("new_customer_high_return_count"),
        count(flag("is_repeat_customer")).alias("_repeat"),
        count(flag("is_one_time_buyer")).alias("_once"),
        exact_sum(F.when(_in_decile(), flag("total_revenue")).otherwise(0.0), 4).alias("_decile"),
        exact_sum(F.when(new, flag("aov")).otherwise(0.0)).alias("_new_aov"),
    ).join(marks, list(by))

    def pct(part: Column | str, whole: Column | str = "customers") -> Column:
        return safe_div(part, whole) * 100

    return counted.withColumns({
        "lapsed_pct": pct("lapsed_count"),
        "going_quiet_pct": pct("_quiet"),
        "top_10_pct_revenue_share": pct("_decile", "all_revenue"),
        "discount_dependent_pct": pct("discount_dependent_count"),
        "vip_pct": pct("_vips"),
        "top_product_concentration_pct": pct("top_product_customers"),
        "single_product_buyer_pct": pct("_single"),
        "peak_month_pct": pct("top_month_customers", "month_known"),
        "repeat_rate_pct": pct("_repeat"),
        "one_time_buyer_pct": pct("_once"),
        "new_aov_premium_pct": F.when(
            F.col("new_customer_count") > 0,
            (safe_div(safe_div("_new_aov", "new_customer_count"), "mean_aov") - 1) * 100,
        ).otherwise(0.0),
    })


def triggered(metrics: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The catalogue triggers that hold, with the metric's value."""
    names = sorted({metric for _, _, _, metric, _, _ in PORTFOLIO_TRIGGERS})
    long = metrics.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names
        ])).alias("_m"),
    ).select(*by, "_m.*")
    triggers = F.broadcast(  # 25 fixed rows
        metrics.sparkSession.createDataFrame(
            PORTFOLIO_TRIGGERS,
            "insight_id string, title string, category string, metric string, operator string, threshold double",
        )
    )
    value, threshold = F.col("value"), F.col("threshold")
    holds = (
        F.when(F.col("operator") == "gte", value >= threshold)
        .when(F.col("operator") == "gt", value > threshold)
        .when(F.col("operator") == "lt", value < threshold)
        .otherwise(value <= threshold)
    )
    return long.join(triggers, "metric").where(holds)
