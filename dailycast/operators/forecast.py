"""Recursive multi-day forecast per outlet.

Plan
----
1-3. ``forecast_state``: one window ``partitionBy(Outlet).orderBy(Date desc)``
   ranks each outlet's rows; ranks 1..14 are grouped per outlet (the window
   and the grouping reuse the feature table's Outlet partitioning, so no
   shuffle is added): rank 1 is the anchor row (features of the latest date,
   optionally inside a period), and the ranks inside the calendar window
   ``[last_date - 13 days, last_date]`` are the history, in date order.
   ``last_row_per_outlet`` (J4), ``recent_history`` (W4) and
   ``history_state`` expose the same steps as separate operators.
4. Forecast per outlet, from ``pred_start`` to ``end`` day by day:
   the day's calendar features overwrite the anchor's, the predictor scores
   the row, then ``lag_14 <- lag_7 <- lag_1 <- y`` (a cascade), ``y`` is
   appended to the history (last 14 kept) and ``ma_7``/``ma_14`` are the
   means of its last 7 / 14 values.

Step 4 has two engines: :func:`forecast_with_expression` folds the days in a
Catalyst ``aggregate`` (any predictor written as a Column expression; no
Python), and ``dailycast.plans.tree_forecast`` scores Spark ML tree
ensembles in Arrow batches.  Both consume the state built here, one row per
outlet, partitioned by Outlet.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailycast.functions.columns import add_days, calendar_struct, day_spine, last_n, mean_of, ntz_literal
from dailycast.operators.select import filter_by_period, filter_outlet, period_condition
from dailycast.schema import (
    CALENDAR_COLUMNS,
    DATE,
    HISTORY_KEEP,
    LOOKBACK_DAYS,
    MIN_HISTORY_ROWS,
    NUMERIC_FEATURES,
    OUTLET,
    TARGET,
    WEEKEND_DAYS,
)

PREDICTED = "Predicted Sales"
STATE_FEATURES = ["lag_1", "lag_7", "lag_14", "ma_7", "ma_14"]


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return ntz_literal(value)


# --- steps 1-3: state ----------------------------------------------------------

def last_row_per_outlet(features: DataFrame, anchor_period: Mapping | None = None) -> DataFrame:
    """The feature row at the latest Date of each outlet (optionally the
    latest Date inside ``anchor_period``; outlets without rows there drop out,
    which is J5's restriction to the period's outlets)."""
    src = filter_by_period(features, **anchor_period) if anchor_period else features
    cols = [c for c in features.columns if c != OUTLET]
    return (src.groupBy(OUTLET).agg(F.max_by(F.struct(*cols), F.col(DATE)).alias("_r"))
            .select(OUTLET, "_r.*"))


def recent_history(features: DataFrame, last: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows of each outlet with Date in [last_date - (lookback-1) days, last_date]."""
    anchor = last.select(OUTLET, F.col(DATE).alias("_last"))
    rows = features.select(OUTLET, DATE, TARGET).join(anchor, OUTLET)
    lo = add_days(F.col("_last"), -(lookback_days - 1))
    return rows.where((F.col(DATE) >= lo) & (F.col(DATE) <= F.col("_last"))).drop("_last")


def history_state(recent: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """Per outlet: ``n_hist`` rows in the window and ``hist``, the values of
    the latest ``keep`` rows in date order."""
    rn = F.row_number().over(Window.partitionBy(OUTLET).orderBy(F.col(DATE).desc()))
    ranked = recent.withColumn("_rn", rn)
    kept = F.sort_array(F.collect_list(F.when(F.col("_rn") <= keep, F.struct(DATE, TARGET))))
    return ranked.groupBy(OUTLET).agg(
        F.count(F.lit(1)).alias("n_hist"),
        F.transform(kept, lambda s: s[TARGET]).alias("hist"),
    )


def skipped_outlets(history: DataFrame, min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Outlets whose lookback window has fewer than ``min_rows`` rows."""
    return history.where(F.col("n_hist") < min_rows).select(OUTLET, F.col("n_hist").alias("days"))


@dataclass(frozen=True)
class ForecastSpec:
    """Horizon and dialect switches of the recursive forecast.

    ``clamp_start``: start at ``max(last_date + 1, start)`` (library) or at
    ``last_date + 1`` (scripts).  ``anchor_period``: take the anchor row from
    this period (scripts); ``outlet``: forecast one outlet only (applied
    before any work, outlets are independent)."""
    start: str | dt.date
    end: str | dt.date
    clamp_start: bool = True
    anchor_period: Mapping | None = None
    outlet: str | None = None
    weekend_days: Sequence[int] = WEEKEND_DAYS
    min_history: int = MIN_HISTORY_ROWS

    def months(self) -> list[str]:
        """The months (``yyyy-MM``) from ``start`` to ``end``."""
        a, b = (dt.date.fromisoformat(str(x)[:10]) for x in (self.start, self.end))
        return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(a.year * 12 + a.month - 1, b.year * 12 + b.month)]


def _period_end(anchor_period: Mapping) -> Column | None:
    y, m = anchor_period.get("year"), anchor_period.get("month")
    if y is None:
        return None
    if m is None:
        return _ts(dt.datetime(y + 1, 1, 1))
    return _ts(dt.datetime(y + 1, 1, 1) if m == 12 else dt.datetime(y, m + 1, 1))


def forecast_state(features: DataFrame, spec: ForecastSpec, keep: int = HISTORY_KEEP,
                   lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """One row per outlet that will be forecast: anchor features, ``n_hist``,
    ``hist``, ``pred_start``, ``pred_end``.  Outlets with too little history
    or an empty horizon are left out (see :func:`skipped_outlets`).

    Built from one window over ``partitionBy(Outlet).orderBy(Date desc)``:
    the anchor is rank 1, the history is ranks 1..14 inside the calendar
    window.  The window reuses the feature table's Outlet partitioning and
    the rank filter becomes a per-group limit, so no extra shuffle and no
    group larger than 14 rows is ever collected.  ``n_hist`` counts the
    window's rows up to ``keep`` (enough for the ``< min_history`` rule,
    since ``min_history <= keep``)."""
    if spec.min_history > keep:
        raise ValueError("min_history must not exceed the kept history")
    df = filter_outlet(features, spec.outlet)
    if spec.anchor_period:
        end = _period_end(spec.anchor_period)
        if end is not None:
            df = df.where(F.col(DATE) < end)             # rows after the period never matter
        else:                                            # the same month of any year: up to its last row
            inside = F.when(period_condition(**spec.anchor_period), F.col(DATE))
            df = (df.withColumn("_anchor", F.max(inside).over(Window.partitionBy(OUTLET)))
                  .where(F.col(DATE) <= F.col("_anchor")).drop("_anchor"))
    w = Window.partitionBy(OUTLET).orderBy(F.col(DATE).desc())
    ranked = df.withColumn("_rn", F.row_number().over(w))
    top = ranked.where(F.col("_rn") <= keep)
    cols = [c for c in features.columns if c != OUTLET]
    state = top.groupBy(OUTLET).agg(
        F.max_by(F.struct(*cols), F.col(DATE)).alias("_r"),
        F.sort_array(F.collect_list(F.struct(DATE, TARGET))).alias("_h"),
    )
    state = state.select(OUTLET, "_r.*", "_h")
    in_window = F.filter("_h", lambda s: s[DATE] >= add_days(F.col(DATE), -(lookback_days - 1)))
    state = (state.withColumn("_h", in_window)
             .withColumn("n_hist", F.size("_h"))
             .withColumn("hist", F.transform("_h", lambda s: s[TARGET])).drop("_h"))
    if spec.anchor_period:
        state = state.where(period_condition(**spec.anchor_period))
    state = state.where(F.col("n_hist") >= spec.min_history)
    nxt = add_days(F.col(DATE), 1)
    start = F.greatest(nxt, _ts(spec.start)) if spec.clamp_start else nxt
    return (state.withColumn("pred_start", start)
            .withColumn("pred_end", _ts(spec.end))
            .where(F.col("pred_start") <= F.col("pred_end")))


def spread(state: DataFrame) -> DataFrame:
    """Hash-distribute the per-outlet state over ``spark.sql.shuffle.partitions``
    tasks before CPU-heavy per-outlet work (a setting, not the cores that happen
    to be there when the plan is made).  The state is one small row per outlet,
    so adaptive execution would otherwise coalesce it by bytes into very few
    tasks; a fixed-count repartition is kept as is.  (A key other than the
    bare Outlet column, so the planner does not drop it as already satisfied
    by the upstream Outlet partitioning.)"""
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return state.repartition(n, F.xxhash64(OUTLET))


# --- step 4, engine A: Catalyst fold ---------------------------------------------

Predictor = Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class LinearPredictor:
    """``intercept + sum(weight * feature)`` over numeric features, evaluated
    left to right as a Catalyst expression."""
    terms: tuple[tuple[float, str], ...]
    intercept: float = 0.0
    name: str = "linear"

    def __post_init__(self):
        bad = [f for _, f in self.terms if f not in NUMERIC_FEATURES]
        if bad:
            raise ValueError(f"not numeric features: {bad}")

    def column(self, feats: Mapping[str, Column]) -> Column:
        out = F.lit(float(self.intercept))
        for w, f in self.terms:
            out = out + F.lit(float(w)) * feats[f].cast("double")
        return out

    def __call__(self, feats: Mapping[str, Column]) -> Column:
        return self.column(feats)


# Baseline forecasters used by the registered queries (fixed here, not fitted).
BLEND = LinearPredictor(((0.5, "ma_7"), (0.3, "lag_1"), (0.2, "lag_14")), name="blend")
WEEKLY = LinearPredictor(((0.6, "ma_14"), (0.4, "lag_7"), (2.5, "is_weekend")), intercept=1.0, name="weekly")


def forecast_with_expression(state: DataFrame, predictor: Predictor,
                             weekend_days: Sequence[int] = WEEKEND_DAYS) -> DataFrame:
    """M12/M13 with a Column predictor: the whole recursion is one Catalyst
    ``aggregate`` over the day spine of each outlet, then ``explode``.

    No shuffle: rows stay in the Outlet partitioning of the state."""
    days = day_spine(F.col("pred_start"), F.col("pred_end"))
    init = F.struct(*[F.col(c).cast("double").alias(c) for c in STATE_FEATURES],
                    F.col("hist").cast("array<double>").alias("hist"),
                    F.array().cast(f"array<struct<{DATE}:timestamp_ntz,y:double>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        cal = calendar_struct(d, weekend_days)
        feats = {c: cal[c] for c in CALENDAR_COLUMNS}
        feats.update({c: acc[c] for c in STATE_FEATURES})
        y = predictor(feats)

        def with_y(yv: Column) -> Column:
            def with_hist(h: Column) -> Column:
                return F.struct(
                    yv.alias("lag_1"), acc["lag_1"].alias("lag_7"), acc["lag_7"].alias("lag_14"),
                    mean_of(last_n(h, 7)).alias("ma_7"), mean_of(h).alias("ma_14"),
                    h.alias("hist"),
                    F.concat(acc["out"], F.array(F.struct(d.alias(DATE), yv.alias("y")))).alias("out"))
            return F.transform(F.array(last_n(F.concat(acc["hist"], F.array(yv)), HISTORY_KEEP)),
                               with_hist)[0]
        return F.transform(F.array(y.cast("double")), with_y)[0]

    folded = state.select(OUTLET, F.aggregate(days, init, step)["out"].alias("_out"))
    return (folded.select(OUTLET, F.explode("_out").alias("_p"))
            .select(OUTLET, F.col(f"_p.{DATE}").alias(DATE), F.col("_p.y").alias(PREDICTED)))


def predict_daily(features: DataFrame, spec: ForecastSpec, predictor: Predictor) -> DataFrame:
    """M12 (library dialect by default; M13 via ``spec``) with a Column predictor."""
    return forecast_with_expression(spread(forecast_state(features, spec)), predictor, spec.weekend_days)
