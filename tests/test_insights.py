import pytest
from pyspark.sql import functions as F

from merchantry.operators import drilldown
from merchantry.operators import insights as i
from merchantry.operators.customers import customer360
from test_customers import order, sales


def build(spark):
    """Merchant t: 20 customers. Ten lapsed, one of them large; ten buy in the last days.
    Merchant u: no revenue. Merchant v: three customers."""
    rows = []
    for n in range(10):
        rows.append(order(n, f"old{n}", f"2023-01-{n + 1:02d}", 5000.0 if n == 0 else 10.0, "Coat", tenant="t"))
        rows.append(order(100 + n, f"new{n}", f"2024-03-{n + 1:02d}", 40.0, "Coat" if n < 6 else "Hat", 2.0, tenant="t"))
    rows.append(order(300, "zero", "2024-03-01", 0.0, tenant="u"))
    rows += [order(400 + n, f"v{n}", "2024-03-01", 9.0, tenant="v") for n in range(3)]
    return customer360(sales(spark, rows))


@pytest.fixture(scope="module")
def tables(spark):
    customers = build(spark).cache()
    marks = i.group_marks(customers)
    fired = i.insights(i.portfolio(customers, marks)).cache()
    return customers, marks, fired


def rows_of(fired, tenant):
    return {r.insight_id: r for r in fired.where(F.col("tenant_id") == tenant).collect()}


def test_which_rules_fire(tables):
    fired = tables[2]
    assert set(rows_of(fired, "t")) == {
        "retention-lapsed-high-value", "retention-overall-lapse-rate", "discount-dependency", "cohort-low-repeat-rate",
        "concentration-top10pct", "concentration-product", "seasonality-peak-month",
    }
    assert rows_of(fired, "u") == {}
    assert "cohort-low-repeat-rate" not in rows_of(fired, "v")


def test_figures_and_texts(tables):
    t = rows_of(tables[2], "t")
    lapsed = t["retention-overall-lapse-rate"]
    assert (lapsed.affected_count, lapsed.revenue_at_stake, lapsed.confidence) == (10, 5090.0, "high")
    assert lapsed.headline == "50% of your customer base has lapsed — above healthy levels"
    assert lapsed.data_logic == (
        "10 customers flagged is_lapsed=True out of 20 total. Lapse rate: 50.0%. Industry benchmark: <15%."
    )
    # 40 for confidence, 40 times 5090 of 5490 revenue, 14 for timing.
    assert lapsed.score == pytest.approx(40 + 40 * 5090 / 5490 + 14, abs=0.005)
    top = t["concentration-top10pct"]
    assert (top.affected_count, top.revenue_at_stake) == (2, 5040.0)
    assert top.data_logic == (
        "Top 2 customers by total_revenue (top 10%). Their combined revenue: £5,040 = 91.8% of total £5,490."
    )
    product = t["concentration-product"]
    assert product.headline == "'Coat' is the most-bought item for 80% of your customers"
    assert product.suggested_action.startswith("Cross-sell complementary items to buyers of 'Coat'.")
    assert t["seasonality-peak-month"].headline == "January is your biggest buying month — 50% of orders land then"
    assert t["discount-dependency"].explanation.startswith(
        "10 customers used a discount on more than 70% of their orders. You've given away £20 in discounts"
    )
    assert t["cohort-low-repeat-rate"].explanation.startswith("0 of your 20 customers have placed 2+ orders.")


def test_ranking_by_score_then_rule(tables):
    got = sorted(rows_of(tables[2], "t").values(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, 8))
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_members(tables):
    customers, marks, fired = tables
    members = i.insight_members(customers, marks, fired)
    counts = {(r.tenant_id, r.insight_id): r["count"] for r in members.groupBy("tenant_id", "insight_id").count().collect()}
    for r in fired.where("insight_id <> 'cohort-low-repeat-rate'").collect():
        assert counts[(r.tenant_id, r.insight_id)] == r.affected_count
    listed = i.listed_members(members, limit=1).where("insight_id = 'concentration-top10pct'").collect()
    assert [r.customer_key for r in listed] == ["old0"]
    assert i.listed_members(members, limit=10_000).count() == members.count()
    behind = drilldown.insight_customers(customers, members, "discount-dependency")
    assert behind.count() == 10


def test_portfolio_triggers(tables):
    customers, marks, _ = tables
    got = {r.insight_id for r in i.triggered(i.portfolio_metrics(customers, marks)).where("tenant_id = 't'").collect()}
    assert {"retention-overall-lapse-rate", "growth-lapsed-recovery-pool", "inventory-anchor-sku-risk", "loyalty-vip-underweight"} <= got
    assert "returns-high-portfolio-rate" not in got


STATE = "tenant_id string, action_key string, is_done boolean, snoozed boolean, snooze_upload_id string, updated_at string"


def test_action_state_latest_entry_counts(spark):
    groups = spark.createDataFrame([("t", k, k) for k in "abcde"], "tenant_id string, action string, action_key string")
    log = spark.createDataFrame([
        ("t", "a", True, False, None, "1"), ("t", "b", False, True, None, "1"), ("t", "c", False, True, "old", "1"),
        ("t", "d", False, True, "now", "2"), ("t", "d", True, False, None, "1"), ("t", "e", False, True, "", "1"),
    ], STATE)
    got = {r.action_key: r.is_done for r in drilldown.apply_action_state(groups, log, F.lit("now")).collect()}
    assert got == {"a": True, "c": False}


def test_action_customers_fall_back_to_the_action_name(spark):
    customers = spark.createDataFrame(
        [("t", "x", "Send SMS!", 5.0), ("t", "y", "Wait", 7.0), ("t", "z", "Wait", 9.0)],
        "tenant_id string, customer_key string, recommended_action string, total_revenue double",
    ).withColumns({
        "order_count": F.lit(1), "last_order_date": F.lit("2024-01-05").cast("timestamp_ntz"), "action_reason": F.lit("r"),
        "suggested_channel": F.lit("c"), "suggested_timing": F.lit("s"),
    })
    members = spark.createDataFrame([("t", "y", "send-sms"), ("t", "gone", "wait")], "tenant_id string, customer_key string, action_key string")
    from_plan = drilldown.action_customers(customers, members, "send-sms").collect()
    assert [r.email_or_id for r in from_plan] == ["y"]
    by_name = drilldown.action_customers(customers, members, "wait").collect()
    assert sorted(r.email_or_id for r in by_name) == ["y", "z"]
    assert by_name[0].last_order_date == "05 Jan 2024"


def test_fallback_cards_for_groups_without_insights(spark):
    groups = spark.createDataFrame(
        [("t", 1, "Win back lapsed", "high", 1, 5.0, "Email", "Now"), ("u", 1, "Convert", "low", 2, 6.0, "SMS", "Later")],
        "tenant_id string, position int, action string, action_priority string, customer_count bigint, "
        "total_revenue_at_stake double, suggested_channel string, suggested_timing string",
    )
    insights = spark.createDataFrame([("u",)], "tenant_id string")
    cards = drilldown.fallback_cards(groups, insights).collect()
    assert [(r.tenant_id, r.category, r.score, r.insight_id) for r in cards] == [("t", "retention_risk", 80.0, "fallback-0")]
    assert cards[0].explanation == "1 customer needs this action. Best channel: Email. Timing: Now."
