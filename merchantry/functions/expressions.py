"""Scalar expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; 0 when it is null, infinite or not a number."""
    quotient = F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
    return finite(quotient)


def finite(value: Column | str) -> Column:
    """The value as double, with null, NaN and infinities replaced by 0."""
    value = _col(value).cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(usable, value).otherwise(F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent; 0 when there is no usable previous value."""
    return finite((F.try_divide(current.cast("double"), previous.cast("double")) - 1) * 100)


def round_to(value: Column | str, digits: int) -> Column:
    """Round a double half up by one fixed formula, equal on every engine."""
    scale = float(10**digits)
    return F.floor(_col(value).cast("double") * scale + 0.5) / scale


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def time_of_day(ts: Column | str) -> Column:
    """Time since midnight as an interval."""
    ts = _col(ts).cast("timestamp_ntz")
    return ts - ts.cast("date").cast("timestamp_ntz")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days from `earlier` to `later`, rounded toward minus infinity."""
    borrowed = F.when(time_of_day(later) < time_of_day(earlier), 1).otherwise(0)
    return F.datediff(day_of(later), day_of(earlier)) - borrowed


def period_start(ts: Column | str, period: str) -> Column:
    """First day of the day, week (Monday) or month the timestamp falls in."""
    day = day_of(ts)
    if period == "daily":
        return day
    if period == "weekly":
        return F.trunc(day, "week")
    if period == "monthly":
        return F.trunc(day, "month")
    raise ValueError(f"unknown period: {period}")


def period_label(start: Column, period: str) -> Column:
    return F.date_format(start, "yyyy-MM" if period == "monthly" else "yyyy-MM-dd")


def month_label(start: Column) -> Column:
    return F.date_format(start, "MMM yyyy")


def day_label(ts: Column | str) -> Column:
    """`05 Jan 2024`, or an empty string without a date."""
    return F.coalesce(F.date_format(_col(ts).cast("timestamp_ntz"), "dd MMM yyyy"), F.lit(""))


def slug(text: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def words(code: Column | str) -> Column:
    """`this_week` as `this week`."""
    return F.replace(_col(code), F.lit("_"), F.lit(" "))


def title_words(code: Column | str) -> Column:
    """`this_week` as `This Week`."""
    return F.initcap(words(code))


def pounds(amount: Column | str) -> Column:
    """Whole pounds with thousands commas."""
    return F.concat(F.lit("£"), F.format_number(_col(amount).cast("double"), 0))


def whole(value: Column | str) -> Column:
    """Rounded to the nearest integer, ties to the even one."""
    return F.bround(_col(value).cast("double"), 0).cast("bigint")


def plural(count: Column, suffix: str = "s") -> Column:
    return F.when(count == 1, "").otherwise(suffix)


def blank(text: Column | str) -> Column:
    text = _col(text)
    return text.isNull() | (F.trim(text.cast("string")) == "")


def money(value: Column | str) -> Column:
    """Amount as an exact decimal, so that sums do not depend on row order."""
    return _col(value).cast("decimal(18,4)")


def exact_sum(value: Column | str, digits: int = 6) -> Column:
    """Sum of doubles, each rounded to `digits`, that does not depend on row order."""
    return F.sum(round_to(value, digits).cast(f"decimal(38,{digits})")).cast("double")
