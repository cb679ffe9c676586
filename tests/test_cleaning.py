import datetime as dt

import pytest
from pyspark.sql import functions as F

from merchantry.operators import cleaning as c


def texts(spark, column, values):
    return spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], f"tenant_id string, row_pos bigint, {column} string")


def column(df, name):
    return [r[name] for r in df.orderBy("row_pos").collect()]


def test_day_first_column(spark):
    got = column(c.parse_dates(texts(spark, "order_date", ["15/02/2023", "03/04/2023", "not a date", None])), "order_date")
    assert got == [dt.datetime(2023, 2, 15), dt.datetime(2023, 4, 3), None, None]


def test_month_first_column_and_tie(spark):
    got = column(c.parse_dates(texts(spark, "order_date", ["02/15/2023", "03/04/2023"])), "order_date")
    assert got == [dt.datetime(2023, 2, 15), dt.datetime(2023, 3, 4)]
    assert column(c.parse_dates(texts(spark, "order_date", ["03/04/2023"])), "order_date") == [dt.datetime(2023, 3, 4)]


def test_iso_dates_with_time_and_offset(spark):
    values = ["2026-05-08 09:15:00 +0000", "2026-05-08T09:15:30Z", "2026-05-08", "2026-13-08", " 2026-05-08 09:15 ", "2026-05-08 +0530"]
    got = column(c.parse_dates(texts(spark, "order_date", values)), "order_date")
    assert got == [
        dt.datetime(2026, 5, 8, 9, 15), dt.datetime(2026, 5, 8, 9, 15, 30), dt.datetime(2026, 5, 8), None,
        dt.datetime(2026, 5, 8, 9, 15), dt.datetime(2026, 5, 8),
    ]


def test_other_shapes_of_dates(spark):
    day = dt.datetime(2023, 2, 15)
    values = {
        "Feb 15, 2023": day, "February 15 2023": day, "15 Feb 2023": day, "15-feb-2023": day, "Wed, 15 Feb 2023 10:00:00 GMT": day.replace(hour=10),
        "Sept 5th, 2023": dt.datetime(2023, 9, 5), "20230215": day, "20230215 09:15": day.replace(hour=9, minute=15), "2023/02/15": day,
        "2023.2.5": dt.datetime(2023, 2, 5), "02/15/23": day, "02/15/69": dt.datetime(1969, 2, 15), "02/15/68": dt.datetime(2068, 2, 15),
        "02/15/2023 3:30 PM": day.replace(hour=15, minute=30), "02/15/2023 12:30 a.m.": day.replace(minute=30),
        "02/15/2023 12:00:01 pm": day.replace(hour=12, second=1), "2023-02-15 15:30 PM": None, "2023-02-15 0:30 AM": None,
        "2023-02-15 23:30:00 -0800": day.replace(hour=23, minute=30), "Foo 15, 2023": None, "Feb 30, 2023": None, "20231315": None,
        "2023-02/15": None, "123": None, "1234567": None, "": None, "Feb 15": None, "15 Feb 2023 extra": None,
    }
    got = column(c.parse_dates(texts(spark, "order_date", list(values))), "order_date")
    assert dict(zip(values, got)) == values


def test_numbers_and_core_defaults(spark):
    values = ["£1,234.50", "", "null", "None", "NaN", "-20", "12,50", "abc", None, " 7 ", "€5", "¥9"]
    parsed = c.parse_numbers(texts(spark, "total", values))
    got = [None if v is None else float(v) for v in column(parsed, "total")]
    assert got == [1234.5, None, None, None, None, -20.0, 1250.0, None, None, 7.0, 5.0, 9.0]
    filled = [float(v) for v in column(c.core_defaults(parsed), "total")]
    assert filled == [1234.5, 0, 0, 0, 0, 20.0, 1250.0, 0, 0, 7.0, 5.0, 9.0]
    signed = [float(v) for v in column(c.core_defaults(parsed, signed_totals=True), "total")]
    assert signed[5] == -20.0
    quantity = c.core_defaults(c.parse_numbers(texts(spark, "quantity", ["", "-3", "0"])))
    assert column(quantity, "quantity") == [1.0, 3.0, 0.0]


def test_booleans_and_strings(spark):
    flags = c.parse_booleans(texts(spark, "accepts_marketing", ["Yes", "0", "maybe", None, "TRUE", "n", "1"]))
    assert column(flags, "accepts_marketing") == [True, False, False, False, True, False, True]
    tidy = c.tidy_strings(texts(spark, "currency", [" GBP ", None, "nan", "NULL", ""]))
    assert column(tidy, "currency") == ["GBP", "", "", "", ""]


RAW = [
    (0, "#1", "a@x", "01/02/2024", "5", "Coat"),
    (1, "#1", "a@x", "01/02/2024", "9", "Hat"),
    (2, "", "a@x", "01/03/2024", "5", "Coat"),
    (3, "#2", "nobody", "01/03/2024", "5", "Coat"),
    (4, " #3 ", " b@x ", "bad", "", ""),
    (5, "#1", "a@x", "01/02/2024", "7", "Coat"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [("t", *r) for r in RAW],
        "tenant_id string, row_pos bigint, order_id string, customer_email string, order_date string, total string, product_name string",
    )


def test_clean_orders(raw):
    got = {r.order_id: r for r in c.clean_orders(raw, [F.col("row_pos")]).collect()}
    assert set(got) == {"#1", "#3"}
    assert (float(got["#1"].total), got["#1"].product_name) == (5.0, "Coat")
    assert (float(got["#3"].total), got["#3"].product_name, got["#3"].customer_email) == (0.0, "Unknown Product", "b@x")
    assert got["#3"].order_date is None


def test_problems_and_duplicates_see_raw_rows(raw):
    problems = {(r.row, r.field, r.severity) for r in c.row_problems(raw).collect()}
    assert problems == {(4, "order_id", "error"), (6, "total", "error"), (6, "product_name", "warning")}
    duplicates = sorted((r.row, r.order_id) for r in c.duplicate_orders(raw).collect())
    assert duplicates == [(3, "#1"), (7, "#1")]


def test_whole_row_duplicates_without_order_id(spark):
    rows = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b")], "tenant_id string, x string")
    assert c.drop_duplicate_orders(rows, []).count() == 2


def test_typed_feed(spark):
    feed = spark.createDataFrame(
        [("1", "a", "p", " 5.5 "), ("2", "b", "p", "free")], "order_id string, customer_id string, product_id string, price string"
    )
    assert [float(r.price) for r in c.typed_feed(feed, "sales").collect()] == [5.5]
    with pytest.raises(ValueError, match="Missing required columns: category"):
        c.typed_feed(feed.withColumnRenamed("order_id", "name"), "products")


def test_sanitised(spark):
    rows = spark.createDataFrame([(float("nan"), None), (float("inf"), 2.0), (1.5, 3.0)], "a double, b double")
    assert sorted((r.a, r.b) for r in c.sanitised(rows).na.fill(-1.0).collect()) == [(0.0, -1.0), (0.0, 2.0), (1.5, 3.0)]


def test_a_date_is_judged_without_being_made(spark):
    """What counts as unreadable follows from the numbers; building a wrong date would throw once a row and reading."""
    texts = ["31/12/2020", "12/31/2020", "29/02/2023", "29/02/2024", "02/29/1900", "2020-13-01", "0000-01-01", "5/6/69",
             "1/2/2020 24:00", "1/2/2020 23:59:60", "1/2/2020 13:00 PM", "1/2/2020 12:00 am", "no date", "", None]
    shapes = spark.createDataFrame([(t,) for t in texts], "text string").select("text", c._date_shape(F.col("text")).alias("shape"))
    for day_first in (False, True):
        is_date = c._is_date(F.col("shape"), day_first)
        assert "make_timestamp" not in str(is_date).lower()
        rows = shapes.select("text", is_date.alias("is_date"), c.parse_date(F.col("text"), day_first).isNotNull().alias("read")).collect()
        assert [r.text for r in rows if r.is_date != r.read] == []
        assert sum(r.is_date for r in rows) == 5 + day_first
