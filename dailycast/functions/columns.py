"""Column-level building blocks (all Catalyst expressions, no Python at run time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dailycast.schema import MONEY, WEEKEND_DAYS


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from a date/datetime/ISO string, built from
    text so that no time zone (session or Python process) is involved."""
    import datetime as dt
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = f"{value.isoformat()} 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(c: str | Column) -> Column:
    """Micro-seconds since 1970-01-01 of a ``timestamp_ntz`` wall-clock value,
    independent of the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def from_epoch_micros(c: Column) -> Column:
    """Inverse of :func:`epoch_micros` (``timestamp_ntz``)."""
    return F.timestamp_add("MICROSECOND", c, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def day_start(c: str | Column) -> Column:
    """Midnight of the same day as ``timestamp_ntz`` (no time zone involved)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c).cast("timestamp_ntz")


def money(c: str | Column) -> Column:
    """Amount as exact DECIMAL; NaN counts as missing (pandas skips it in sums)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double")).cast(MONEY)


def is_weekend(d: Column, weekend_days: Sequence[int] = WEEKEND_DAYS) -> Column:
    return F.weekday(d).isin(list(weekend_days)).cast("int")


def calendar_struct(d: Column, weekend_days: Sequence[int] = WEEKEND_DAYS) -> Column:
    """day, weekday, ISO week, month, year, is_weekend of a date/timestamp."""
    return F.struct(
        F.dayofmonth(d).alias("day"),
        F.weekday(d).alias("weekday"),
        F.weekofyear(d).alias("week"),
        F.month(d).alias("month"),
        F.year(d).alias("year"),
        is_weekend(d, weekend_days).alias("is_weekend"),
    )


def month_string(d: Column) -> Column:
    """Month period as ``yyyy-MM``."""
    return F.date_format(d, "yyyy-MM")


def iso_string(d: Column) -> Column:
    """ISO-8601 text of a timestamp (seconds precision)."""
    return F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")


def add_days(d: Column, n: int | Column) -> Column:
    """Timestamp/date plus ``n`` days, keeping the input type."""
    n = F.lit(n) if isinstance(n, int) else n
    return d + F.make_dt_interval(days=n)


def day_spine(start: Column, end: Column) -> Column:
    """Inclusive array of days ``start..end``; empty when ``start > end``
    (Spark's ``sequence`` would count down instead)."""
    return F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 DAY"))) \
        .otherwise(F.array().cast("array<timestamp_ntz>"))


def mean_of(arr: Column) -> Column:
    """Mean of a double array, summed left to right (NULL when empty)."""
    total = F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.when(F.size(arr) > 0, total / F.size(arr))


def last_n(arr: Column, n: int) -> Column:
    """The last ``n`` elements of an array (all when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), n)


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` or NULL when the denominator is zero (ANSI-safe)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))
