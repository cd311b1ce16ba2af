"""Daily series and model features: aggregation, calendar, lags, averages.

All windows share ``partitionBy(Outlet).orderBy(Date)``, so the lags and the
moving averages are computed by one window operator after one shuffle.  A
series has at most one row per (Outlet, Date), so a window partition is
bounded by the number of distinct timestamps of one outlet, never by the
number of raw transactions.  For series with very many timestamps per
outlet, ``layout="blocks"`` bounds every task by a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailycast.functions.columns import calendar_struct, day_start, epoch_micros, money
from dailycast.operators.ranking import rank_in_group
from dailycast.schema import (
    DATE,
    DISCOUNT,
    LAGS,
    MOVING_AVERAGES,
    OUTLET,
    TARGET,
    WEEKEND_DAYS,
)


def series_window():
    return Window.partitionBy(OUTLET).orderBy(DATE)


def drop_null_keys(df: DataFrame) -> DataFrame:
    """Rows with a NULL Outlet or Date do not form a group."""
    return df.where(F.col(OUTLET).isNotNull() & F.col(DATE).isNotNull())


def with_discount(df: DataFrame) -> DataFrame:
    """P10: a missing ``Total Discount`` column means no discount (0.0)."""
    if DISCOUNT in df.columns:
        return df
    return df.withColumn(DISCOUNT, F.lit(0.0))


def daily_sales(tx: DataFrame, grain: str = "exact") -> DataFrame:
    """A1: sum sales and discount per (Outlet, Date).

    ``grain="exact"`` groups on the timestamp as given (reference behaviour);
    ``grain="day"`` truncates it to the day first.  NULL keys are dropped and
    a group whose amounts are all NULL sums to 0.0.  Sums are exact DECIMAL
    (partial aggregation before the shuffle, so a hot outlet is combined
    map-side) and returned as DOUBLE."""
    if grain not in ("exact", "day"):
        raise ValueError("grain must be 'exact' or 'day'")
    df = with_discount(tx)
    if grain == "day":
        df = df.withColumn(DATE, day_start(DATE))
    df = drop_null_keys(df)
    return df.groupBy(OUTLET, DATE).agg(
        F.coalesce(F.sum(money(TARGET)).cast("double"), F.lit(0.0)).alias(TARGET),
        F.coalesce(F.sum(money(DISCOUNT)).cast("double"), F.lit(0.0)).alias(DISCOUNT),
    )


def date_features(df: DataFrame, weekend_days: Sequence[int] = WEEKEND_DAYS,
                  date_col: str = DATE) -> DataFrame:
    """day, weekday (Mon=0), ISO week, month, year, is_weekend."""
    cal = calendar_struct(F.col(date_col), weekend_days)
    return df.withColumns({c: cal[c] for c in ("day", "weekday", "week", "month", "year", "is_weekend")})


def _moving_average(y: Column, n: int, full_window: bool, exclude_current: bool, w) -> Column:
    frame = w.rowsBetween(-n, -1) if exclude_current else w.rowsBetween(-(n - 1), 0)
    s = F.sum(money(y)).over(frame).cast("double")
    c = F.count(y).over(frame)
    avg = F.when(c > 0, s / c)
    return F.when(c == n, avg) if full_window else avg


def _lag_columns(y: Column, w, full_window: bool, exclude_current: bool) -> dict:
    cols = {f"lag_{n}": F.lag(y, n).over(w) for n in LAGS}
    cols.update({f"ma_{n}": _moving_average(y, n, full_window, exclude_current, w)
                 for n in MOVING_AVERAGES})
    return cols


_CHUNK_MICROS = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000}


def series_rank(df: DataFrame, chunk_unit: str = "DAY") -> DataFrame:
    """Add ``_r``: the 1-based position of each row in its outlet's series,
    without a window over a whole outlet (chunks = time buckets of Date)."""
    chunk = F.floor(epoch_micros(DATE) / F.lit(_CHUNK_MICROS[chunk_unit]))
    return rank_in_group(df, OUTLET, [DATE], chunk)


def _lag_features_blocks(df: DataFrame, full_window: bool, exclude_current: bool, target: str,
                         block_rows: int, chunk_unit: str) -> DataFrame:
    halo = max(max(LAGS), max(MOVING_AVERAGES))
    if block_rows < halo:
        raise ValueError(f"block_rows must be at least {halo}")
    ranked = series_rank(df, chunk_unit)
    blk = F.floor((F.col("_r") - 1) / F.lit(block_rows))
    pos = (F.col("_r") - 1) % F.lit(block_rows)
    own = ranked.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    copies = (ranked.where(pos >= block_rows - halo)
              .withColumn("_blk", blk + 1).withColumn("_halo", F.lit(True)))
    w = Window.partitionBy(OUTLET, "_blk").orderBy("_r")
    out = own.unionByName(copies).withColumns(_lag_columns(F.col(target), w, full_window, exclude_current))
    return out.where(~F.col("_halo")).drop("_r", "_blk", "_halo")


MAX_WINDOW_ROWS = 1_000_000   # layout="auto": larger series use the block layout


def choose_layout(df: DataFrame, max_window_rows: int = MAX_WINDOW_ROWS) -> tuple[DataFrame, str]:
    """``layout="auto"``: the series table is checkpointed once (it is small
    next to the raw rows) and one aggregate finds the longest series; above
    ``max_window_rows`` rows the block layout is used.  Returns the
    checkpointed table (read by the features) and the layout."""
    from dailycast.session import materialize
    df = materialize(df)
    longest = df.groupBy(OUTLET).count().agg(F.max("count")).first()[0] or 0
    return df, ("blocks" if longest > max_window_rows else "window")


def lag_features(df: DataFrame, full_window: bool = False, exclude_current: bool = False,
                 target: str = TARGET, layout: str = "window", block_rows: int = 4096,
                 chunk_unit: str = "DAY", max_window_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """``lag_1/7/14`` (row shifts, calendar gaps ignored) and
    ``ma_7/14`` (mean over the last n rows including the current one).

    ``full_window=False``: at least one value (library dialect, W2);
    ``full_window=True``: NULL until n values exist (legacy scripts, W3);
    ``exclude_current=True``: the average ends one row earlier (no leak).

    ``layout="window"`` (default): one window per outlet -- right when a
    series has one row per day, so a window partition is bounded by the
    number of days even for the hottest outlet.  ``layout="blocks"``: for
    series with many timestamps per outlet (exact grain, a hot outlet may
    hold a third of all rows): rows get their series rank (per-chunk counts
    + offsets), are cut into blocks of ``block_rows`` ranks, and each block
    also receives the previous block's last 14 rows; the same windows then
    run per (Outlet, block).  Results are identical.  ``layout="auto"``
    measures the longest series first (:func:`choose_layout`)."""
    if layout == "auto":
        df, layout = choose_layout(df, max_window_rows)
    if layout == "blocks":
        return _lag_features_blocks(df, full_window, exclude_current, target, block_rows, chunk_unit)
    if layout != "window":
        raise ValueError("layout must be 'window', 'blocks' or 'auto'")
    return df.withColumns(_lag_columns(F.col(target), series_window(), full_window, exclude_current))


def drop_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN in any column."""
    return df.na.drop("any")


def prepare_features(tx: DataFrame, drop_nans: bool = True, grain: str = "exact",
                     full_window: bool = False, exclude_current: bool = False,
                     weekend_days: Sequence[int] = WEEKEND_DAYS, layout: str = "window") -> DataFrame:
    """Daily sums -> calendar features -> lags and averages -> [drop NULL rows]."""
    daily = daily_sales(tx, grain)
    feats = lag_features(date_features(daily, weekend_days), full_window, exclude_current, layout=layout)
    return drop_nulls(feats) if drop_nans else feats


def legacy_features(tx: DataFrame, weekend_days: Sequence[int] = WEEKEND_DAYS) -> DataFrame:
    """Feature table of the legacy scripts: full-window averages, NULL rows dropped."""
    return prepare_features(tx, drop_nans=True, full_window=True, weekend_days=weekend_days)
