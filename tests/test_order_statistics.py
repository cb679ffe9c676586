"""Ranks and quantiles against numpy, also with ties, hot groups and tiny groups."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchantry.operators import order_statistics
from merchantry.operators.order_statistics import OrderedGroups, keys_at, quantiles, top_rows, values_at


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, k string")


def skewed(n=3000, seed=5):
    """One group holds most rows, one value most of that group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 else f"g{i % 40}"
        rows.append((g, 1.0 if rng.random() < 0.4 else round(rng.random() * 100, 2), f"k{i:05d}"))
    return rows


def test_ranks_of_every_row(spark):
    rows = skewed()
    groups = OrderedGroups(frame(spark, rows), ["g"], [F.col("v"), F.col("k")])
    got = {(r.g, r.k): r["rank"] for r in groups.ranked().collect()}
    by_group = {}
    for g, v, k in rows:
        by_group.setdefault(g, []).append((v, k))
    expected = {(g, k): i + 1 for g, items in by_group.items() for i, (v, k) in enumerate(sorted(items))}
    assert got == expected


def test_hot_group_spans_partitions(spark):
    groups = OrderedGroups(frame(spark, skewed()), ["g"], [F.col("v"), F.col("k")])
    parts = groups.blocks.where("g = 'hot'").count()
    assert parts > 2
    assert groups.blocks.where("g = 'hot'").agg(F.sum("_rows")).first()[0] == 2000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 500)), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, pairs):
    rows = [(g, float(v) / 4, f"k{i}") for i, (g, v) in enumerate(pairs)]
    got = {r.g: r for r in quantiles(frame(spark, rows), ["g"], "v", {"p20": 0.2, "p80": 0.8}, extremes=True).collect()}
    for g in {r[0] for r in rows}:
        values = [v for h, v, _ in rows if h == g]
        assert got[g].n == len(values)
        assert got[g].p20 == pytest.approx(np.quantile(values, 0.2), abs=1e-4)
        assert got[g].p80 == pytest.approx(np.quantile(values, 0.8), abs=1e-4)
        assert (got[g].lowest, got[g].highest) == (min(values), max(values))


def test_top_rows_limit_before_shuffle(spark):
    best = top_rows(frame(spark, skewed()), ["g"], [F.desc("v"), F.asc("k")], 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    hot = sorted((-v, k) for g, v, k in skewed() if g == "hot")[:3]
    got = best.where("g = 'hot'").orderBy("rank").collect()
    assert [(-r.v, r.k) for r in got] == hot


def test_long_lists_are_ranked_by_ranges(spark):
    best = top_rows(frame(spark, skewed()), ["g"], [F.desc("v"), F.asc("k")], 1500)
    hot = sorted((-v, k) for g, v, k in skewed() if g == "hot")[:1500]
    got = best.where("g = 'hot'").orderBy("rank").collect()
    assert [(-r.v, r.k) for r in got] == hot


def test_a_value_most_rows_share_is_spread(spark):
    rows = [("hot", 1.0, f"k{i:05d}") for i in range(4000)] + [("hot", 2.0, "z")]
    groups = OrderedGroups(frame(spark, rows), ["g"], [F.col("v"), F.col("k")])
    assert groups.blocks.agg(F.max("_rows")).first()[0] < 2000
    assert quantiles(frame(spark, rows), ["g"], "v", {"p80": 0.8}).first().p80 == 1.0


@pytest.mark.parametrize("whole", [10_000, 100])
def test_values_and_keys_at_ranks(spark, monkeypatch, whole):
    """Against sorting; also when larger groups are bracketed by sketches. The plan sorts and stores no rows."""
    monkeypatch.setattr(order_statistics, "_WHOLE", whole)
    rng = random.Random(whole)
    rows = [(g, float(rng.choice([v, rng.randrange(8), -v / 3])), f"{rng.choice(['a', 'customer-', 'é'])}{i * 7919 % 5000}") for g in "xyz" for i, v in enumerate(range(2500 if g != "z" else 3))]
    ranks = {str(s): (s / 5, F.lit(1) + F.floor(F.lit(s) * (F.col("n") - 1) / 5)) for s in range(1, 5)}
    df = frame(spark, rows + [("x", None, "none")])
    found = values_at(df, ["g"], "v", ranks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    last = keys_at(df, ["g"], "v", "k", found.select("g", "label", "value", (F.col("rank") - F.col("smaller")).alias("rank")))
    got = {(r.g, r.label): (r.value, r.k) for r in last.collect()}
    for g in "xyz":
        order = sorted((v, k) for h, v, k in rows if h == g)
        for s in range(1, 5):
            assert got[g, str(s)] == order[s * (len(order) - 1) // 5]


def test_no_rows(spark):
    df = frame(spark, [])
    assert quantiles(df, ["g"], "v", {"p": 0.5}, extremes=True).count() == 0
    assert keys_at(df, ["g"], "v", "k", spark.createDataFrame([], "g string, label string, value double, rank long")).count() == 0
