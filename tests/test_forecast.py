import datetime as dt

import numpy as np
import pytest

from merchantry.operators import forecast as fc


def monthly(spark, series):
    rows = []
    for group, values in series.items():
        for i, v in enumerate(values):
            rows.append((group, dt.date(2023 + i // 12, i % 12 + 1, 1), float(v)))
    return spark.createDataFrame(rows, "tenant_id string, month date, revenue double")


def by_hand(values):
    """The weighted smoother written out step by step."""
    n = len(values)
    weights = np.ones(n)
    weights[-4:] = [1, 4, 9, 16]
    weights = weights / weights.sum() * n
    level, trend = np.average(values[:3], weights=weights[:3]), values[1] - values[0]
    for i in range(1, n):
        a, b = min(0.8, 0.4 * weights[i]), min(0.6, 0.3 * weights[i])
        previous = level
        level = a * values[i] + (1 - a) * (level + trend)
        trend = b * (level - previous) + (1 - b) * trend
    return level, trend


SERIES = {
    "long": [100, 120, 90, 130, 150, 170, 160, 210, 190, 230, 250, 240, 260],
    "six": [10, 20, 30, 20, 10, 5],
    "falling": [900, 700, 500, 300, 100, 10, 5],
    "five": [10, 20, 30, 40, 50],
    "three": [30, 20, 10],
    "sinking": [90, 50, 1],
    "two": [5, 6],
}


@pytest.fixture(scope="module")
def rows(spark):
    out = {}
    for r in fc.forecast(monthly(spark, SERIES)).orderBy("tenant_id", "period").collect():
        out.setdefault(r.tenant_id, []).append(r)
    return out


@pytest.mark.parametrize("group", ["long", "six", "falling"])
def test_smoothing(rows, group):
    level, trend = by_hand([float(v) for v in SERIES[group]])
    ahead = [r.revenue for r in rows[group] if r.type == "forecast"]
    assert ahead == pytest.approx([max(0.0, level + trend * h) for h in (1, 2, 3)], rel=1e-12)
    kept = [r for r in rows[group] if r.type == "validation"]
    expected = [
        max(0.0, 0.85 * (level + trend * (i - 1)) + 0.15 * SERIES[group][i - 2]) for i in range(2)
    ]
    assert [r.predicted_revenue for r in kept] == pytest.approx(expected, rel=1e-12)
    assert sum(r.type == "actual" for r in rows[group]) == len(SERIES[group]) - 2


def test_simple(rows):
    assert [r.revenue for r in rows["five"] if r.type == "forecast"] == pytest.approx([40 + 20 / 3 * h for h in (1, 2, 3)])
    assert [r.revenue for r in rows["three"] if r.type == "forecast"] == pytest.approx([20 - 20 / 3 * h for h in (1, 2)] + [0.0], abs=1e-9)
    assert [r.revenue for r in rows["sinking"] if r.type == "forecast"][-1] == 0.0
    assert [r.type for r in rows["two"]] == ["actual", "actual"]


def test_labels_and_chart(spark, rows):
    assert [(r.period, r.display_name) for r in rows["long"]][-1] == ("2024-04", "Apr 2024")
    chart = fc.chart_series(fc.forecast(monthly(spark, {"five": SERIES["five"]}))).orderBy("period").collect()
    assert (chart[0].actual, chart[0].forecast) == (10.0, None)
    assert chart[-1].actual is None and chart[-1].forecast is not None


def test_fit_quality(spark):
    level, trend = by_hand([float(v) for v in SERIES["long"]])
    predicted = np.array([0.85 * (level + trend * (i - 1)) + 0.15 * SERIES["long"][i - 2] for i in range(2)])
    actual = np.array(SERIES["long"][-2:], dtype=float)
    got = fc.fit_quality(fc.monthly_series(monthly(spark, {"long": SERIES["long"]}))).first()
    assert got.mae == pytest.approx(np.abs(predicted - actual).mean(), rel=1e-12)
    r2 = 1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()
    assert got.r2 == pytest.approx(r2, rel=1e-10)
