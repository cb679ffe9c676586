"""Exact ranks and quantiles inside groups of any size.

A window ordered inside a group, or a percentile aggregate, puts the whole group
on one task. Single ranks and quantiles are selected without storing or sorting rows: sketches that merge
say between which values a rank lies, then counts of the few values between decide. Where every row
needs its rank, the rows are range-partitioned on (group, order), so a large
group spans many partitions; only one count per (group, partition) is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.functions.expressions import round_to
from merchantry.session import store

# monotonically_increasing_id: partition number above, row number below bit 33.
_ROW_BITS = 33
_RANGE_BYTES = 64 << 20


class OrderedGroups:
    """`df` stored in sorted order, with the size of every group's blocks."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "ordered"):
        self.by = list(by)
        keys = [F.col(c) for c in self.by]
        # Stored first: the ranges are cut from a sample of the input, and their number follows its true size.
        source = store(df, name + "-input")
        size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _RANGE_BYTES))
        placed = (
            source.repartitionByRange(parts, *keys, *order)
            .sortWithinPartitions(*keys, *order)
            .withColumn("_pos", F.monotonically_increasing_id())
        )
        self.rows = store(placed, name)
        part = F.shiftrightunsigned("_pos", _ROW_BITS)
        # One row per group and partition it touches.
        counts = self.rows.groupBy(*self.by, part.alias("_part")).agg(
            F.count("*").alias("_rows"), F.min("_pos").alias("_first")
        )
        inside = Window.partitionBy(*self.by)
        before = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        self.blocks = store(
            counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
            .withColumn("_n", F.sum("_rows").over(inside)),
            name + "-blocks",
        )

    def sizes(self) -> DataFrame:
        return self.blocks.groupBy(*self.by).agg(F.max("_n").alias("n"))

    def at(self, ranks: dict[str, Column]) -> DataFrame:
        """The row at each wanted 1-based rank; `ranks` may refer to column `n`.

        Returns the group columns, `n`, `label`, `rank` and the row's columns.
        """
        wanted = self.sizes().withColumn(
            "_want",
            F.explode(F.array(*[
                F.struct(F.lit(label).alias("label"), rank.cast("bigint").alias("rank"))
                for label, rank in ranks.items()
            ])),
        ).select(*self.by, "n", "_want.label", "_want.rank")
        placed = (
            wanted.join(self.blocks.drop("_n"), self.by)
            .where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_rows")))
            .withColumn("_pos", F.col("_first") + F.col("rank") - F.col("_before") - 1)
            .select(*self.by, "n", "label", "rank", "_pos")
        )
        return self.rows.join(placed, [*self.by, "_pos"]).drop("_pos")

    def ranked(self, rank: str = "rank") -> DataFrame:
        """Every row with its 1-based rank in its group."""
        rows = self.rows.withColumn("_part", F.shiftrightunsigned("_pos", _ROW_BITS))
        blocks = self.blocks.select(*self.by, "_part", "_before", "_first")
        return (
            rows.join(blocks, [*self.by, "_part"])
            .withColumn(rank, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
            .drop("_part", "_pos", "_before", "_first")
        )


_ACCURACY = 10_000  # a sketch's ranks are right to within n / _ACCURACY
_MARGIN = 10 / _ACCURACY
_WHOLE = 10_000  # groups of no more rows are counted value by value


def values_at(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, tuple[float, Column]]
) -> DataFrame:
    """The value at each wanted rank: group, n, label, rank, value, `smaller` (rows below it) and `equal` (rows with it).

    `ranks` gives for each label the share of the group where it lies and the 1-based rank, a column of `n`, which
    must be within two of that share. Null values count nowhere. `df` is read twice: for n and sketches of the
    shares around each label, then for counts: rows between two brackets count as one, those inside by value.
    A rank that its bracket missed would stop the job, so what is returned is exact.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    shares = sorted({share for share, _ in ranks.values()})
    around = [min(max(share + side * _MARGIN, 0.0), 1.0) for share in shares for side in (-1, 1)]
    # Stored: one row a group.
    edges = store(rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("_value", around, _ACCURACY).alias("_around")), "rank-brackets")
    low = [F.when(F.col("n") > _WHOLE, F.col("_around")[2 * i]).otherwise(F.lit(float("-inf"))) for i in range(len(shares))]
    high = [F.when(F.col("n") > _WHOLE, F.col("_around")[2 * i + 1]).otherwise(F.lit(float("inf"))) for i in range(len(shares))]
    v = F.col("_value")
    inside = F.lit(False)
    for a, b in zip(low, high):
        inside |= v.between(a, b)
    next_low = F.coalesce(*[F.when(a > v, a) for a in low], F.lit(float("inf")))
    counted = rows.join(edges, by).groupBy(*by, F.when(inside, v).otherwise(next_low).alias("value"), inside.alias("_inside")).agg(
        F.count("*").alias("equal"), F.first("n").alias("n"))
    before = Window.partitionBy(*by).orderBy("value", "_inside").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("smaller", F.coalesce(F.sum("equal").over(before), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(label).alias("label"), rank.cast("bigint").alias("rank")) for label, (_, rank) in ranks.items()])
    here = F.explode(F.filter(wanted, lambda w: (w["rank"] > F.col("smaller")) & (w["rank"] <= F.col("smaller") + F.col("equal"))))
    found = placed.withColumn("_want", here)
    exact = F.when(F.col("_inside"), F.col("value")).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    return found.select(*by, "n", "_want.label", "_want.rank", exact.alias("value"), "smaller", "equal")


_DIGIT = 3  # characters of a key that a round looks at


def _common(a: Column, b: Column) -> Column:
    """The characters that two texts begin with in common."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    n = F.aggregate(places, F.lit(0), lambda held, i: F.when((held == i - 1) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(held))
    return a.substr(F.lit(1), n)


def keys_at(df: DataFrame, by: Sequence[str], value: str, key: str, wanted: DataFrame) -> DataFrame:
    """The key at a rank among rows of one value: group, label, value, key, for `wanted` (group, label, value, rank).

    Keys are texts, distinct within a group and a value, in their own order. Each round counts the next few characters of
    the keys that are left, on each task first, and follows those that the rank falls on; characters that all have are skipped.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("value"), F.col(key).alias("_key"))
    left = store(wanted.select(*by, "label", "value", "rank", F.lit("").alias("_prefix")), "rank-keys")
    found: list[DataFrame] = []
    while True:
        at = F.length("_prefix")
        digit = F.col("_key").substr(at + 1, F.lit(_DIGIT))
        counted = rows.join(left, [*by, "value"]).where(F.col("_key").startswith(F.col("_prefix"))).groupBy(
            *by, "label", "value", "rank", digit.alias("_digit")).agg(F.count("*").alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"))
        before = Window.partitionBy(*by, "label").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = store(placed.where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))), "rank-keys")
        found.append(hit.where("_low = _high").select(*by, "label", "value", F.col("_low").alias(key)))
        left = hit.where("_low <> _high").select(
            *by, "label", "value", (F.col("rank") - F.col("_before")).alias("rank"), _common(F.col("_low"), F.col("_high")).alias("_prefix"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float], extremes: bool = False) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per point, plus `n`.

    Edges are rounded to 4 decimals so that they compare equally on any engine.
    """
    by = list(by)
    ranks: dict[str, tuple[float, Column]] = {}
    for name, p in points.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        ranks[name + "_lo"] = (p, F.floor(position) + 1)
        ranks[name + "_hi"] = (p, F.ceil(position) + 1)

    def picked(label: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col("value")))

    edges = []
    for name, p in points.items():
        position = (F.max("n") - 1) * F.lit(float(p))
        low, high = picked(name + "_lo"), picked(name + "_hi")
        edges.append(round_to(low + (high - low) * (position - F.floor(position)), 4).alias(name))
    found = values_at(df, by, value, ranks).groupBy(*by).agg(F.max("n").alias("n"), *edges)
    if not extremes:
        return found
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        round_to(F.min(F.col(value).cast("double")), 4).alias("lowest"), round_to(F.max(F.col(value).cast("double")), 4).alias("highest"))
    return found.join(ends, by)


def top_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank", long_lists: bool = False
) -> DataFrame:
    """The first `limit` rows of every group, ranked. `order` must be a total order.

    The rank filter is applied on each task before the shuffle, so a group of any size sends at
    most `limit` rows per task; Spark does so up to `spark.sql.optimizer.windowGroupLimitThreshold`.
    For lists beyond that ask for `long_lists`: they are ranked by range partitioning.
    """
    if long_lists:
        return OrderedGroups(df, by, order, "top-rows").ranked(rank).where(F.col(rank) <= limit)
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def in_list_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], position: str = "position") -> DataFrame:
    """Every row with its place in its group's list, from 1, for lists of any length. `order` must be a total order."""
    return OrderedGroups(df, by, order, "list").ranked(position)
