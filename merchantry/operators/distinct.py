"""Exact distinct counts of several columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_distinct_counts(totals: DataFrame, rows: DataFrame, by: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """`totals`, one row a group, with the exact number of distinct values of a column of `rows` for each name in `counts`.

    Each count is one narrow aggregation of its own column, made distinct on each task first; rows are not
    multiplied by the number of counts, as several distinct counts in one aggregation would.
    """
    for name, column in counts.items():
        known = rows.where(F.col(column).isNotNull()).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(column).alias("_value"))
        groups = [f"_by{i}" for i in range(len(by))]
        found = known.distinct().groupBy(*groups).agg(F.count("*").alias("_found"))
        same = reduce(lambda a, b: a & b, [totals[c].eqNullSafe(found[g]) for c, g in zip(by, groups)], F.lit(True))
        totals = totals.join(found, same, "left").withColumn(name, F.coalesce("_found", F.lit(0).cast("bigint"))).drop("_found", *groups)
    return totals
