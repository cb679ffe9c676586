"""Revenue forecast per group from its monthly series.

A series is one short array per group, so the smoother runs as an array fold in
one pass, for all groups in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.expressions import finite, month_label, period_label

TENANT = ["tenant_id"]

# Months needed, horizon, smoothing weights.
SMOOTHING_MONTHS = 6
SIMPLE_MONTHS = 3
HORIZON = 3
RECENT_MONTHS = 4
LEVEL_WEIGHT, LEVEL_CAP = 0.4, 0.8
TREND_WEIGHT, TREND_CAP = 0.3, 0.6
MODEL_SHARE, ACTUAL_SHARE = 0.85, 0.15


def monthly_series(monthly: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One row per group: its months in order, at most one entry per month."""
    return monthly.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("month", F.col("revenue").cast("double").alias("revenue")))).alias("series")
    ).withColumn("n", F.size("series"))


def _raw_weight(i: Column) -> Column:
    """1, and 1, 4, 9, 16 for the last four months."""
    recent = i - (F.col("n") - RECENT_MONTHS - 1)
    return F.when(i >= F.col("n") - RECENT_MONTHS, recent * recent).otherwise(1).cast("double")


def smoothed(series: DataFrame) -> DataFrame:
    """Level and trend after the last month, for series of six months and more."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, i: acc + _raw_weight(i)
    )
    # `inline` gives each value as a column that is worked out once, however often it is used.
    long = series.where(F.col("n") >= SMOOTHING_MONTHS).select(
        "*", F.inline(F.array(F.struct(total.alias("_total"))))
    )

    def revenue(i: Column) -> Column:
        return F.try_element_at("series", (i + 1).cast("int"))["revenue"]

    def weight(i: Column) -> Column:
        return _raw_weight(i) / F.col("_total") * F.col("n")

    start = sum((revenue(F.lit(i)) * weight(F.lit(i)) for i in range(1, 3)), revenue(F.lit(0)) * weight(F.lit(0)))
    start_weight = sum((weight(F.lit(i)) for i in range(1, 3)), weight(F.lit(0)))
    state = F.struct(
        (start / start_weight).alias("level"), (revenue(F.lit(1)) - revenue(F.lit(0))).alias("trend")
    )

    def step(acc: Column, i: Column) -> Column:
        a = F.least(F.lit(LEVEL_CAP), F.lit(LEVEL_WEIGHT) * weight(i))
        b = F.least(F.lit(TREND_CAP), F.lit(TREND_WEIGHT) * weight(i))
        level = a * revenue(i) + (F.lit(1.0) - a) * (acc["level"] + acc["trend"])
        trend = b * (level - acc["level"]) + (F.lit(1.0) - b) * acc["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"))

    fitted = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), state, step)
    return long.select("*", F.inline(F.array(fitted))).drop("_total")


def _backcast(i: int) -> Column:
    """The fitted line blended with the actual, for the last two months (i = 0, 1)."""
    actual = F.try_element_at("series", F.lit(i - 2))["revenue"]
    line = F.col("level") + F.col("trend") * F.lit(i - 1)
    return F.greatest(F.lit(0.0), F.lit(MODEL_SHARE) * line + F.lit(ACTUAL_SHARE) * actual)


def _row(month: Column, revenue: Column, predicted: Column, kind: str) -> Column:
    return F.struct(
        month.alias("month"), finite(revenue).alias("revenue"), predicted.alias("predicted_revenue"),
        F.lit(kind).alias("type"),
    )


def _history(until: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.transform(
        F.slice("series", F.lit(1), until), lambda m: _row(m["month"], m["revenue"], none, "actual")
    )


def _ahead(h: int) -> Column:
    return F.add_months(F.try_element_at("series", F.lit(-1))["month"], h)


def _labelled(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    out = rows.select(*by, F.explode("_rows").alias("_row")).select(*by, "_row.*")
    return out.select(
        *by,
        period_label(F.col("month"), "monthly").alias("period"),
        month_label(F.col("month")).alias("display_name"),
        "revenue",
        "predicted_revenue",
        "type",
    )


def smoothing_forecast(series: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """History, two validation months and three months ahead."""
    none = F.lit(None).cast("double")
    tail = [
        _row(F.try_element_at("series", F.lit(i - 2))["month"], F.try_element_at("series", F.lit(i - 2))["revenue"],
             finite(_backcast(i)), "validation")
        for i in range(2)
    ]
    future = [
        _row(_ahead(h), F.greatest(F.lit(0.0), F.col("level") + F.col("trend") * F.lit(h)), none, "forecast")
        for h in range(1, HORIZON + 1)
    ]
    rows = F.concat(_history(F.col("n") - 2), F.array(*tail, *future))
    return _labelled(smoothed(series).withColumn("_rows", rows), by)


def simple_forecast(series: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Mean of the last three months plus a third of their rise per month.

    Series under three months keep only their history.
    """
    last = [F.try_element_at("series", F.lit(-k))["revenue"] for k in (3, 2, 1)]
    mean = (last[0] + last[1] + last[2]) / F.lit(3.0)
    rise = (last[2] - last[0]) / F.lit(3.0)
    none = F.lit(None).cast("double")
    future = F.array(*[
        _row(_ahead(h), F.greatest(F.lit(0.0), mean + rise * F.lit(h)), none, "forecast")
        for h in range(1, HORIZON + 1)
    ])
    history = _history(F.col("n"))
    rows = F.when(F.col("n") >= SIMPLE_MONTHS, F.concat(history, future)).otherwise(history)
    return _labelled(series.withColumn("_rows", rows), by)


def forecast(monthly: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """The smoothing forecast from six months on, the simple one below."""
    series = monthly_series(monthly, by)
    short = series.where(F.col("n") < SMOOTHING_MONTHS)
    return smoothing_forecast(series, by).unionByName(simple_forecast(short, by))


def fit_quality(series: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """Mean absolute error and R² over the two validation months."""
    actual = [F.try_element_at("series", F.lit(i - 2))["revenue"] for i in range(2)]
    error = [_backcast(i) - actual[i] for i in range(2)]
    mean = (actual[0] + actual[1]) / F.lit(2.0)
    residual = error[0] * error[0] + error[1] * error[1]
    spread = (actual[0] - mean) * (actual[0] - mean) + (actual[1] - mean) * (actual[1] - mean)
    r2 = F.when(spread != 0, F.lit(1.0) - F.try_divide(residual, spread)).otherwise(0.0)
    return smoothed(series).select(
        *by, ((F.abs(error[0]) + F.abs(error[1])) / F.lit(2.0)).alias("mae"), r2.alias("r2"),
        "level", "trend",
    )


def chart_series(rows: DataFrame, by: Sequence[str] = TENANT) -> DataFrame:
    """One `actual` and one `forecast` value per month for a chart."""
    kind = F.col("type")
    return rows.select(
        *by,
        "period",
        F.col("display_name").alias("month"),
        F.when(kind.isin("actual", "validation"), F.col("revenue")).alias("actual"),
        F.when(kind == "validation", F.col("predicted_revenue"))
        .when(kind == "forecast", F.col("revenue"))
        .alias("forecast"),
    )
