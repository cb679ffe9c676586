import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from merchantry.operators import customers as c
from merchantry.operators import growth_plan, recommendations, segments

SCHEMA = "tenant_id string, order_id string, customer_id string, d string, total double, quantity double, product_name string, discount_amount double, refund_amount double"


def sales(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("order_date", F.col("d").cast("timestamp_ntz")).drop("d")
    return df.withColumns({n: F.col(n).cast("decimal(18,4)") for n in ("total", "discount_amount", "refund_amount")})


def order(i, customer, day, total=10.0, product="Coat", discount=0.0, refund=0.0, tenant="t"):
    return (tenant, f"o{i}", customer, day, total, 1.0, product, discount, refund)


def by_key(df):
    return {r.customer_key: r for r in df.collect()}


def test_late_order_on_the_last_day_has_recency_minus_one(spark):
    rows = [order(1, "a", "2024-03-10 14:00:00"), order(2, "b", "2024-03-10 00:00:00"), order(3, "c", "2024-03-09 14:00:00")]
    got = by_key(c.customer360(sales(spark, rows)))
    assert [got[k].days_since_last_order for k in "abc"] == [-1, 0, 0]
    assert [got[k].is_new_customer for k in "abc"] == [False, True, True]


def test_reference_date_is_capped(spark):
    rows = [order(1, "a", "2024-03-10"), order(2, "a", "2024-03-01")]
    got = by_key(c.customer360(sales(spark, rows), as_of=F.lit("2024-03-05").cast("date")))
    assert got["a"].days_since_last_order == -5
    later = by_key(c.customer360(sales(spark, rows), as_of=F.lit("2025-01-01").cast("date")))
    assert later["a"].days_since_last_order == 0


def test_fewer_than_five_customers_are_all_high_value(spark):
    four = [order(i, f"c{i}", "2024-01-01", 10.0 * i) for i in range(4)]
    assert all(r.is_high_value for r in c.customer360(sales(spark, four)).collect())
    five = [order(i, f"c{i}", "2024-01-01", 10.0 * i) for i in range(5)]
    got = by_key(c.customer360(sales(spark, five)))
    # The 80th percentile of 0, 10, 20, 30, 40 is 32.
    assert [got[f"c{i}"].is_high_value for i in range(5)] == [False, False, False, False, True]


def gap_by_hand(times):
    distinct = sorted(set(times))
    if len(distinct) < 2:
        return -1.0
    gaps = [(b - a).days for a, b in zip(distinct, distinct[1:])]
    return sum(gaps) / len(gaps)


def test_gaps_match_brute_force_for_a_hot_customer(spark):
    rng = random.Random(3)
    times, rows = {}, []
    for i in range(2500):
        who = "hot" if i % 3 else f"c{i % 60}"
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 200 * 24 * 60, 7))
        times.setdefault(who, []).append(at)
        rows.append(order(i, who, at.strftime("%Y-%m-%d %H:%M:%S")))
    got = by_key(c.order_gaps(c.keyed_rows(sales(spark, rows)), ["tenant_id", "customer_key"]))
    assert {k: r.avg_days_between_orders for k, r in got.items()} == {
        k: pytest.approx(gap_by_hand(v), abs=1e-12) for k, v in times.items()
    }


def test_products_ties_and_missing(spark):
    rows = [
        order(1, "a", "2024-01-02", product="Hat"), order(2, "a", "2024-01-01", product="Scarf"),
        order(3, "a", "2024-01-03", product="Coat"), order(4, "b", "2024-01-03", product=None),
    ]
    got = by_key(c.customer360(sales(spark, rows)))
    assert (got["a"].first_product_purchased, got["a"].most_bought_product) == ("Scarf", "Coat")
    assert got["b"].most_bought_product is None and got["b"].distinct_products_purchased is None


def test_blank_customers_are_skipped_and_counted(spark):
    rows = [order(1, "a", "2024-01-01"), order(2, " ", "2024-01-01"), order(3, None, "2024-01-01")]
    counts = c.skipped_rows(sales(spark, rows)).collect()[0]
    assert (counts.kept_rows, counts.skipped_rows) == (1, 2)
    assert set(by_key(c.customer360(sales(spark, rows)))) == {"a"}


def test_orders_without_optional_columns(spark):
    rows = sales(spark, [order(1, "a", "2024-01-01"), order(2, "a", "2024-02-01")])
    bare = rows.select("tenant_id", "order_id", "customer_id", "total")
    got = by_key(c.customer360(bare, as_of=F.lit("2024-03-01").cast("date")))["a"]
    assert (got.order_count, got.total_revenue, got.days_since_last_order, got.avg_days_between_orders) == (2, 20.0, -1, -1.0)
    assert got.is_full_price_loyal and not got.is_new_customer and not got.is_lapsed


FLAGGED = (
    "tenant_id string, customer_key string, total_revenue double, order_count bigint, discount_usage_rate double, "
    "avg_days_between_orders double, days_since_last_order bigint, high_value_from double"
)


@pytest.mark.parametrize("days,orders,rate,gap,revenue,expected", [
    (180, 1, 0.0, -1.0, 1.0, "Lapsed"), (179, 1, 0.0, -1.0, 1.0, "One-Time Buyers"),
    (31, 2, 0.0, 40.0, 100.0, "VIPs"), (21, 2, 0.1, 10.0, 1.0, "Going Quiet"), (20, 2, 0.1, 10.0, 1.0, "New Customers"),
    (30, 1, 0.0, -1.0, 1.0, "New Customers"), (31, 1, 0.0, -1.0, 1.0, "One-Time Buyers"), (60, 3, 0.71, 0.0, 1.0, "Discount Shoppers"),
    (60, 3, 0.70, 0.0, 1.0, "Regulars"), (-1, 2, 0.5, 5.0, 1.0, "Regulars"),
])
def test_segment_boundaries(spark, days, orders, rate, gap, revenue, expected):
    row = spark.createDataFrame([("t", "a", revenue, orders, rate, gap, days, 50.0)], FLAGGED)
    assert c.with_flags(row).select(c.segment_rule().alias("s")).first().s == expected


@pytest.fixture(scope="module")
def customers(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        day = dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(420))
        rows.append(order(
            i, f"c{rng.randrange(120)}", str(day), round(rng.random() * 300, 2), rng.choice(["Coat", "Hat", "Scarf", None]),
            rng.choice([0.0, 0.0, 5.0]), rng.choice([0.0, 0.0, 0.0, 20.0]), rng.choice(["t", "t", "u"]),
        ))
    return c.customer360(sales(spark, rows)).cache()


def test_segments_partition_the_customers(customers):
    summary = segments.segment_summary(customers).collect()
    assert sum(r.customers for r in summary) == customers.count()
    whole = float(customers.agg(F.sum("total_revenue")).first()[0])
    assert sum(r.total_revenue for r in summary) == pytest.approx(whole, abs=0.01 * len(summary))


def test_refresh_with_the_same_date_changes_nothing(customers):
    columns = ["tenant_id", "customer_key", "days_since_last_order", "is_high_value", "is_at_risk", "is_lapsed", "segment"]
    again = c.refresh_flags(customers)
    assert again.select(*columns).exceptAll(customers.select(*columns)).count() == 0


def test_refresh_fills_missing_columns(spark):
    stored = spark.createDataFrame([("t", "a", 5.0)], "tenant_id string, customer_key string, total_revenue double")
    got = c.refresh_flags(stored, as_of=F.lit("2024-01-01").cast("date")).collect()[0]
    assert (got.order_count, got.days_since_last_order, got.segment) == (0, -1, "Regulars")


def test_scores_stay_in_range_and_match_the_rules_one_by_one(customers):
    scored = recommendations.scored(recommendations.profiles(customers))
    rows = recommendations.ranked(scored, ["tenant_id", "customer_key"]).collect()
    assert rows
    for r in rows:
        assert all(0 <= x <= 1 for x in (r.urgency, r.business_impact, r.confidence, r.customer_value, r.total_score))
        assert 0 <= r.opportunity_score <= 100
    profile = recommendations.profiles(customers)
    for i, entry in enumerate(recommendations.RECOMMENDATIONS):
        expected = {(r.tenant_id, r.customer_key) for r in profile.where(recommendations.rule_predicate(entry)).collect()}
        assert {(r.tenant_id, r.customer_key) for r in rows if r.position == i + 1} == expected


def test_plan_keeps_to_its_members(customers):
    best = growth_plan.recommended(customers)
    members = growth_plan.plan_members(best)
    actions = growth_plan.plan_actions(members)
    assert members.count() <= customers.count()
    assert actions.agg(F.sum("customer_count")).first()[0] == members.count()
    total = growth_plan.plan_totals(actions).where("section is null").agg(F.sum("customer_count")).first()[0]
    assert total == members.count()


def test_unmatched_customers_keep_the_baseline_action(customers):
    acted = growth_plan.with_best_action(customers)
    assert sorted(acted.columns) == sorted(customers.columns)
    best = growth_plan.recommended(customers)
    unmatched = best.where("recommendation_id is null").select("tenant_id", "customer_key")
    joined = acted.join(unmatched, ["tenant_id", "customer_key"]).select("tenant_id", "customer_key", "recommended_action", "action_reason")
    baseline = customers.join(unmatched, ["tenant_id", "customer_key"]).select(
        "tenant_id", "customer_key", "recommended_action", "action_reason"
    )
    assert joined.exceptAll(baseline).count() == 0


def test_trigger_operators(spark):
    row = spark.createDataFrame([(5.0, None, True, 1)], "aov double, most_bought_product string, is_lapsed boolean, order_count bigint")
    T = recommendations.Trigger
    cases = {
        T("aov", "gt", 4): True, T("aov", "gte", 5): True, T("aov", "lt", 5): False, T("aov", "lte", 5): True,
        T("most_bought_product", "neq", None): False, T("is_lapsed", "eq", True): True, T("is_lapsed", "neq", True): False,
        T("order_count", "eq", 1): True, T("unknown", "gt", 1): False, T("aov", "like", 1): False, T("unknown", "neq", 1): True,
    }
    for trigger, expected in cases.items():
        assert row.select(recommendations.trigger_predicate(trigger).alias("x")).first().x is expected, trigger
