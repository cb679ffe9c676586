import math

import pytest
from pyspark.sql import functions as F

from merchantry.operators import rfm


def base(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, customer_key string, monetary double, frequency bigint, recency bigint")


@pytest.mark.parametrize("n", [2, 3, 5, 7, 8, 9, 12, 101])
def test_scores_follow_rank(spark, n):
    """The score of rank r of n is max(1, ceil(5 (r - 1) / (n - 1)))."""
    rows = [("t", f"c{i:03d}", float((i * 37) % 10), i % 3, (i * 11) % 7) for i in range(n)]
    got = {r.customer_key: r for r in rfm.rfm_scores(base(spark, rows)).collect()}

    def ranks(position):
        ordered = sorted(rows, key=lambda r: (r[position], r[1]))
        return {r[1]: i + 1 for i, r in enumerate(ordered)}

    def score(rank):
        return max(1, math.ceil((rank - 1) * 5 / (n - 1)))

    m, f, r = ranks(2), ranks(3), ranks(4)
    for key, row in got.items():
        assert (row.m_score, row.f_score, row.r_score) == (score(m[key]), score(f[key]), 6 - score(r[key]))


def test_every_score_triple_has_a_segment(spark):
    triples = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    got = spark.createDataFrame(triples, "r_score int, f_score int, m_score int").withColumn("s", rfm.rfm_segment())
    counts = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(counts.values()) == 125
    assert "Promising" not in counts


def test_rfm_on_customer_ids_and_missing_dates(spark):
    rows = [("t", "1", "a", None, 5), ("t", "2", "b", "2024-01-01 10:00:00", 7), ("t", "3", "b", "2024-01-09 23:00:00", None)]
    sales = spark.createDataFrame(rows, "tenant_id string, order_id string, customer_id string, d string, total int").select(
        "*", F.col("d").cast("timestamp_ntz").alias("order_date")
    ).drop("d").withColumn("total", F.col("total").cast("decimal(18,4)"))
    got = {r.customer_key: r for r in rfm.rfm_base(sales, F.lit("2024-01-10").cast("timestamp_ntz")).collect()}
    assert (got["a"].recency, got["a"].frequency, got["a"].monetary) == (365, 1, 5.0)
    # The last order was late in the day, so no whole day has passed.
    assert (got["b"].recency, got["b"].frequency, got["b"].monetary) == (0, 1, 7.0)
