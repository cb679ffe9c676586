"""The published 48-order example and its published results."""

import pytest
from pyspark.sql import functions as F

from merchantry.operators import cleaning, customer_revenue, headers, headline, rfm, trends
from merchantry.operators.forecast import forecast

# The example's orders as exported.
ORDERS = """
Order ID,Email,Financial Status,Created at,Currency,Subtotal,Shipping,Taxes,Total,Lineitem quantity,Lineitem name,Lineitem price,Billing Name,Billing City,Billing Country
#1001,sarah.chen@gmail.com,paid,2026-05-08 09:15:00 +0000,GBP,85.00,0.00,0.00,85.00,1,Ribbed Knit Set - Cream,85.00,Sarah Chen,London,United Kingdom
#1002,james.wilson@outlook.com,paid,2026-05-09 14:22:00 +0000,GBP,195.00,0.00,0.00,195.00,1,Leather Jacket - Brown,195.00,James Wilson,Manchester,United Kingdom
#1003,emma.thompson@icloud.com,paid,2026-05-10 11:08:00 +0000,GBP,75.00,0.00,0.00,75.00,1,Wide Leg Jeans - Blue,75.00,Emma Thompson,Bristol,United Kingdom
#1004,olivia.park@hotmail.com,paid,2026-05-11 16:45:00 +0000,GBP,65.00,3.99,0.00,68.99,1,Cargo Trousers - Khaki,65.00,Olivia Park,Birmingham,United Kingdom
#1005,mike.okafor@gmail.com,paid,2026-05-12 20:30:00 +0000,USD,68.00,4.99,0.00,72.99,1,Oversized Hoodie - Black,68.00,Mike Okafor,New York,United States
#1006,luke.henderson@yahoo.com,paid,2026-05-14 13:17:00 +0000,USD,110.00,0.00,0.00,110.00,1,Puffer Vest - Olive,110.00,Luke Henderson,Los Angeles,United States
#1007,priya.sharma@gmail.com,paid,2026-05-16 10:05:00 +0000,GBP,70.00,3.99,0.00,73.99,2,Slouchy Tee 3-Pack,35.00,Priya Sharma,London,United Kingdom
#1008,amara.diallo@gmail.com,paid,2026-05-18 17:33:00 +0000,GBP,90.00,0.00,0.00,90.00,2,Mini Skirt - Black,45.00,Amara Diallo,Edinburgh,United Kingdom
#1009,charlotte.lewis@gmail.com,paid,2026-05-19 12:20:00 +0000,GBP,55.00,3.99,0.00,58.99,1,Oversized Hoodie - Black,55.00,Charlotte Lewis,Leeds,United Kingdom
#1010,grace.wong@gmail.com,paid,2026-05-21 09:40:00 +0000,GBP,85.00,0.00,0.00,85.00,1,Ribbed Knit Set - Cream,85.00,Grace Wong,London,United Kingdom
#1011,sarah.chen@gmail.com,paid,2026-05-22 15:55:00 +0000,GBP,89.00,0.00,0.00,89.00,1,Puffer Vest - Olive,89.00,Sarah Chen,London,United Kingdom
#1012,james.wilson@outlook.com,paid,2026-05-23 11:30:00 +0000,GBP,75.00,0.00,0.00,75.00,1,Wide Leg Jeans - Blue,75.00,James Wilson,Manchester,United Kingdom
#1013,emma.thompson@icloud.com,voided,2026-05-24 08:15:00 +0000,GBP,35.00,3.99,0.00,38.99,1,Slouchy Tee 3-Pack,35.00,Emma Thompson,Bristol,United Kingdom
#1014,olivia.park@hotmail.com,paid,2026-05-25 14:10:00 +0000,GBP,45.00,3.99,0.00,48.99,1,Mini Skirt - Black,45.00,Olivia Park,Birmingham,United Kingdom
#1015,mike.okafor@gmail.com,paid,2026-05-26 19:45:00 +0000,USD,80.00,4.99,0.00,84.99,1,Cargo Trousers - Khaki,80.00,Mike Okafor,New York,United States
#1016,luke.henderson@yahoo.com,paid,2026-05-27 16:20:00 +0000,USD,240.00,0.00,0.00,240.00,1,Leather Jacket - Brown,240.00,Luke Henderson,Los Angeles,United States
#1017,priya.sharma@gmail.com,paid,2026-05-28 10:48:00 +0000,GBP,65.00,3.99,0.00,68.99,1,Cargo Trousers - Khaki,65.00,Priya Sharma,London,United Kingdom
#1018,amara.diallo@gmail.com,paid,2026-05-29 13:25:00 +0000,GBP,85.00,0.00,0.00,85.00,1,Ribbed Knit Set - Cream,85.00,Amara Diallo,Edinburgh,United Kingdom
#1019,charlotte.lewis@gmail.com,paid,2026-05-30 17:00:00 +0000,GBP,89.00,0.00,0.00,89.00,1,Puffer Vest - Olive,89.00,Charlotte Lewis,Leeds,United Kingdom
#1020,sarah.chen@gmail.com,paid,2026-06-01 09:30:00 +0000,GBP,195.00,0.00,0.00,195.00,1,Leather Jacket - Brown,195.00,Sarah Chen,London,United Kingdom
#1021,james.wilson@outlook.com,paid,2026-06-02 14:55:00 +0000,GBP,55.00,3.99,0.00,58.99,1,Oversized Hoodie - Black,55.00,James Wilson,Manchester,United Kingdom
#1022,emma.thompson@icloud.com,paid,2026-06-03 11:12:00 +0000,GBP,65.00,3.99,0.00,68.99,1,Cargo Trousers - Khaki,65.00,Emma Thompson,Bristol,United Kingdom
#1023,olivia.park@hotmail.com,paid,2026-06-04 16:38:00 +0000,GBP,85.00,0.00,0.00,85.00,1,Ribbed Knit Set - Cream,85.00,Olivia Park,Birmingham,United Kingdom
#1024,mike.okafor@gmail.com,paid,2026-06-05 20:15:00 +0000,USD,55.00,4.99,0.00,59.99,1,Mini Skirt - Black,55.00,Mike Okafor,New York,United States
#1025,daniel.brooks@gmail.com,paid,2026-06-07 10:22:00 +0000,USD,92.00,0.00,0.00,92.00,1,Wide Leg Jeans - Blue,92.00,Daniel Brooks,Chicago,United States
#1026,sofia.martinez@gmail.com,paid,2026-06-09 13:40:00 +0000,USD,68.00,4.99,0.00,72.99,1,Oversized Hoodie - Black,68.00,Sofia Martinez,Miami,United States
#1027,noah.baker@gmail.com,paid,2026-06-10 09:05:00 +0000,GBP,70.00,3.99,0.00,73.99,2,Slouchy Tee 3-Pack,35.00,Noah Baker,Glasgow,United Kingdom
#1028,ryan.thomas@gmail.com,paid,2026-06-11 15:30:00 +0000,USD,105.00,0.00,0.00,105.00,1,Ribbed Knit Set - Cream,105.00,Ryan Thomas,Houston,United States
#1029,isabelle.martin@gmail.com,paid,2026-06-12 12:18:00 +0000,GBP,75.00,0.00,0.00,75.00,1,Wide Leg Jeans - Blue,75.00,Isabelle Martin,Liverpool,United Kingdom
#1030,ethan.james@hotmail.com,paid,2026-06-13 17:45:00 +0000,GBP,45.00,3.99,0.00,48.99,1,Mini Skirt - Black,45.00,Ethan James,Sheffield,United Kingdom
#1031,chloe.scott@gmail.com,paid,2026-06-14 11:00:00 +0000,USD,110.00,0.00,0.00,110.00,1,Puffer Vest - Olive,110.00,Chloe Scott,Seattle,United States
#1032,alex.riley@outlook.com,paid,2026-06-15 14:27:00 +0000,GBP,195.00,0.00,0.00,195.00,1,Leather Jacket - Brown,195.00,Alex Riley,Brighton,United Kingdom
#1033,jessica.ford@gmail.com,paid,2026-06-17 10:50:00 +0000,USD,80.00,4.99,0.00,84.99,1,Cargo Trousers - Khaki,80.00,Jessica Ford,Denver,United States
#1034,tom.nguyen@gmail.com,paid,2026-06-18 16:15:00 +0000,GBP,55.00,3.99,0.00,58.99,1,Oversized Hoodie - Black,55.00,Tom Nguyen,Oxford,United Kingdom
#1035,sarah.chen@gmail.com,paid,2026-06-20 09:00:00 +0000,GBP,35.00,3.99,0.00,38.99,1,Slouchy Tee 3-Pack,35.00,Sarah Chen,London,United Kingdom
#1036,james.wilson@outlook.com,paid,2026-06-21 13:35:00 +0000,GBP,89.00,0.00,0.00,89.00,1,Puffer Vest - Olive,89.00,James Wilson,Manchester,United Kingdom
#1037,daniel.brooks@gmail.com,paid,2026-06-22 18:20:00 +0000,USD,240.00,0.00,0.00,240.00,1,Leather Jacket - Brown,240.00,Daniel Brooks,Chicago,United States
#1038,sofia.martinez@gmail.com,paid,2026-06-23 10:45:00 +0000,USD,92.00,0.00,0.00,92.00,1,Wide Leg Jeans - Blue,92.00,Sofia Martinez,Miami,United States
#1039,noah.baker@gmail.com,paid,2026-06-25 15:10:00 +0000,GBP,85.00,0.00,0.00,85.00,1,Ribbed Knit Set - Cream,85.00,Noah Baker,Glasgow,United Kingdom
#1040,ryan.thomas@gmail.com,paid,2026-06-26 11:28:00 +0000,USD,42.00,4.99,0.00,46.99,1,Slouchy Tee 3-Pack,42.00,Ryan Thomas,Houston,United States
#1041,amara.diallo@gmail.com,paid,2026-06-27 14:55:00 +0000,GBP,65.00,3.99,0.00,68.99,1,Cargo Trousers - Khaki,65.00,Amara Diallo,Edinburgh,United Kingdom
#1042,isabelle.martin@gmail.com,paid,2026-06-28 09:20:00 +0000,GBP,89.00,0.00,0.00,89.00,1,Puffer Vest - Olive,89.00,Isabelle Martin,Liverpool,United Kingdom
#1043,priya.sharma@gmail.com,paid,2026-06-29 16:40:00 +0000,GBP,195.00,0.00,0.00,195.00,1,Leather Jacket - Brown,195.00,Priya Sharma,London,United Kingdom
#1044,emma.thompson@icloud.com,paid,2026-07-01 12:05:00 +0000,GBP,90.00,0.00,0.00,90.00,2,Mini Skirt - Black,45.00,Emma Thompson,Bristol,United Kingdom
#1045,mike.okafor@gmail.com,paid,2026-07-02 17:30:00 +0000,USD,105.00,0.00,0.00,105.00,1,Ribbed Knit Set - Cream,105.00,Mike Okafor,New York,United States
#1046,ethan.james@hotmail.com,voided,2026-07-03 10:15:00 +0000,GBP,75.00,0.00,0.00,75.00,1,Wide Leg Jeans - Blue,75.00,Ethan James,Sheffield,United Kingdom
#1047,chloe.scott@gmail.com,paid,2026-07-05 14:50:00 +0000,USD,68.00,4.99,0.00,72.99,1,Oversized Hoodie - Black,68.00,Chloe Scott,Seattle,United States
#1048,sarah.chen@gmail.com,paid,2026-07-06 11:35:00 +0000,GBP,65.00,3.99,0.00,68.99,1,Cargo Trousers - Khaki,65.00,Sarah Chen,London,United Kingdom
""".strip()

BY = ["tenant_id"]


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    """The example read from CSV, its headers matched, its rows cleaned."""
    from merchantry.sources import files

    folder = tmp_path_factory.mktemp("golden")
    (folder / "orders.csv").write_text(ORDERS + "\n", encoding="utf-8-sig")
    scan = files.Exports(spark, str(folder))
    found = scan.headers().selectExpr("'shop' AS tenant_id", "'u1' AS upload_id", "*")
    mapped = files.apply_mapping(scan.fields(), headers.standard_names(found))
    return cleaning.clean_orders(mapped, [F.col("source_file"), F.col("row_pos")], BY).cache()


def one(df):
    return df.collect()[0]


def test_overview(sales):
    row = one(headline.data_overview(sales, BY))
    assert (row.total_rows, row.unique_customers, row.unique_orders, row.unique_products) == (48, 20, 48, 8)


def test_headline(sales):
    as_of = F.lit("2026-07-07 20:00:00").cast("timestamp_ntz")
    assert one(headline.total_revenue(sales, BY)).total_revenue == 4476.79
    assert one(headline.active_customers(sales, BY)).active_customers == 20
    assert one(headline.average_order_value(sales, BY)).average_order_value == pytest.approx(93.26645833333333, rel=1e-15)
    assert one(headline.recency_churn(sales, as_of, BY)).churn_risk_percentage == 0.0


def test_revenue_trend(sales):
    rows = {r.period: r for r in trends.revenue_trend(sales, "monthly", BY).collect()}
    assert [rows[p].revenue for p in ("2026-05", "2026-06", "2026-07")] == [1734.92, 2329.89, 411.98]
    assert [rows[p].orders for p in ("2026-05", "2026-06", "2026-07")] == [19, 24, 5]
    assert rows["2026-06"].change_percent == pytest.approx(34.293800290503285, rel=1e-13)
    assert rows["2026-07"].change_percent == pytest.approx(-82.31762014515706, rel=1e-13)


def test_aov_and_volume(sales):
    rows = {r.period: r for r in trends.aov_trend(sales, "monthly", BY).collect()}
    expected = [91.31157894736843, 97.07875, 82.396]
    assert [rows[p].aov for p in sorted(rows)] == pytest.approx(expected, rel=1e-14)
    volume = {r.period: r for r in trends.order_volume_trend(sales, "monthly", BY).collect()}
    assert [volume[p].total_items for p in sorted(volume)] == [21, 25, 6]


def test_simple_forecast(sales):
    rows = forecast(trends.monthly_revenue(sales, BY), BY).where("type = 'forecast'").orderBy("period").collect()
    assert [r.display_name for r in rows] == ["Aug 2026", "Sep 2026", "Oct 2026"]
    assert [r.revenue for r in rows] == pytest.approx(
        [1051.2833333333333, 610.3033333333333, 169.32333333333327], rel=1e-13
    )


def test_rfm_segments(sales):
    as_of = F.lit("2026-07-07 20:00:00").cast("timestamp_ntz")
    rows = rfm.rfm_summary(rfm.rfm_customers(sales, as_of, BY), BY).collect()
    assert {r.segment: (r.customers, r.total_revenue) for r in rows} == {
        "Champions": (5, 1654.9),
        "Cannot Lose Them": (4, 1165.97),
        "Hibernating": (3, 228.98),
        "Potential Loyalist": (3, 474.98),
        "New Customers": (2, 306.98),
        "At Risk": (1, 147.99),
        "Loyal Customers": (1, 164.99),
        "Need Attention": (1, 332.0),
    }


def test_top_products(sales):
    rows = trends.top_products(sales, 10, "revenue", BY).orderBy("rank").collect()
    assert len(rows) == 8 and {r.total_products for r in rows} == {8}
    first, fourth = rows[0], rows[3]
    assert (first.product_name, first.total_revenue, first.total_quantity, first.unique_orders) == (
        "Leather Jacket - Brown", 1260.0, 6, 6,
    )
    assert (first.avg_unit_price, first.revenue_per_unit) == (210.0, 210.0)
    assert (fourth.product_name, fourth.total_revenue) == ("Cargo Trousers - Khaki", 514.93)
    assert fourth.avg_unit_price == pytest.approx(69.28571428571429, rel=1e-14)
    assert fourth.revenue_per_unit == pytest.approx(73.56142857142856, rel=1e-14)


def test_new_vs_returning(sales):
    rows = {r.period: r for r in trends.new_vs_returning(sales, "customer_email", BY).collect()}
    assert [(rows[p].new_customers, rows[p].returning_customers) for p in sorted(rows)] == [(10, 0), (10, 7), (0, 5)]
    assert rows["2026-06"].returning_customer_revenue == 859.95
    assert rows["2026-07"].returning_customer_revenue == 411.98


def test_locations(sales):
    rows = trends.geo_breakdown(sales, 20, "customer_email", BY).orderBy("rank").collect()
    assert len(rows) == 18
    assert (rows[0].location, rows[0].total_revenue, rows[0].unique_customers, rows[0].total_orders) == (
        "London", 899.96, 3, 9,
    )


def test_customer_revenue(sales):
    customers = customer_revenue.customer_revenue(sales, BY)
    summary = {
        r.segment: r for r in customer_revenue.quartile_summary(customer_revenue.revenue_quartiles(customers, BY), BY).collect()
    }
    assert {s: (summary[s].customer_count, summary[s].total_segment_revenue) for s in ("Low", "Medium", "High", "Premium")} == {
        "Low": (5, 500.96), "Medium": (5, 822.96), "High": (5, 1237.92), "Premium": (5, 1914.95),
    }
    assert summary[None].avg_revenue_per_customer == pytest.approx(223.83949999999996, rel=1e-14)
    best = customer_revenue.top_customers(customers, 10, BY).orderBy("rank").first()
    assert (best.total_revenue, best.total_orders, best.lifetime_days) == (476.98, 5, 60)
