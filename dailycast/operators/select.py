"""Projections and filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.columns import ntz_literal
from dailycast.schema import DATE, FEATURES, OUTLET, PREVIEW_ROWS, TARGET


def select_features(df: DataFrame, with_target: bool = True, with_keys: bool = False) -> DataFrame:
    """The model features in their fixed order (+ target, + Date)."""
    cols = list(FEATURES)
    if with_keys:
        cols = [DATE] + cols
    if with_target:
        cols = cols + [TARGET]
    return df.select(*cols)


def _ts(y: int, m: int, d: int = 1) -> F.Column:
    return ntz_literal(dt.datetime(y, m, d))


def period_condition(year: int | None = None, month: int | None = None, date_col: str = DATE) -> F.Column:
    """Calendar-period predicate.  With a year it is a Date range (prunable
    by parquet statistics); a month alone matches that month in any year."""
    d = F.col(date_col)
    if year is not None and month is not None:
        ny, nm = (year + 1, 1) if month == 12 else (year, month + 1)
        return (d >= _ts(year, month)) & (d < _ts(ny, nm))
    if year is not None:
        return (d >= _ts(year, 1)) & (d < _ts(year + 1, 1))
    if month is not None:
        return F.month(d) == month
    return F.lit(True)


def filter_by_period(df: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Optional year and/or month."""
    if year is None and month is None:
        return df
    return df.where(period_condition(year, month))


def filter_period_set(df: DataFrame, periods: Iterable[tuple[int, Sequence[int]]]) -> DataFrame:
    """P5: OR over (year, months) groups, e.g. [(2024, [11, 12]), (2025, [1])]."""
    cond = F.lit(False)
    for year, months in periods:
        cond = cond | ((F.year(DATE) == year) & F.month(DATE).isin(list(months)))
    return df.where(cond)


def filter_outlet(df: DataFrame, outlet: str | None) -> DataFrame:
    """Optional equality on the outlet (pushed below aggregates/windows
    by Catalyst since Outlet is their partition key)."""
    return df if outlet is None else df.where(F.col(OUTLET) == outlet)


def filter_date_range(df: DataFrame, start: str | dt.date | None = None, end: str | dt.date | None = None,
                      date_col: str = DATE) -> DataFrame:
    """Inclusive bounds on the day of ``date_col``."""
    day = F.to_date(F.col(date_col))
    if start is not None:
        df = df.where(day >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(str(end)).cast("date"))
    return df


def api_daily(df: DataFrame) -> DataFrame:
    """Daily rows in the API's projection ``date, outlet, sales``."""
    return df.select(F.col(DATE).alias("date"), F.col(OUTLET).alias("outlet"), F.col(TARGET).alias("sales"))


def api_predictions(df: DataFrame) -> DataFrame:
    """Forecast rows renamed to ``outlet, date, prediction``."""
    return df.select(F.col(OUTLET).alias("outlet"), F.col(DATE).alias("date"),
                     F.col("Predicted Sales").alias("prediction"))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order: Sequence[str] = (OUTLET, DATE)) -> DataFrame:
    """O3: first ``n`` rows in an explicit total order (top-k, no full sort)."""
    return df.orderBy(*order).limit(n)
