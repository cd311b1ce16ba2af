"""The Catalyst fold against a brute-force loop written directly from the
forecast semantics (one outlet, one day at a time)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.operators import summary as sm
from conftest import ts

DAY = dt.timedelta(days=1)


def _tx(spark):
    rows = []
    for i in range(20):                                   # A: 20 consecutive days
        rows.append(("A", ts("2024-01-01") + i * DAY, 100.0 + 7 * (i % 5) + i))
    for i in list(range(0, 4)) + list(range(12, 17)):     # B: gap -> 5 rows in its lookback
        rows.append(("B", ts("2024-01-01") + i * DAY, 50.0 + i))
    for i in range(9):                                    # C: 9 days, ends early
        rows.append(("C", ts("2024-01-05") + i * DAY, 30.0 + 3 * i))
    return spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")


def _calendar(d, weekend=(4, 5, 6)):
    iso = d.isocalendar()
    return {"day": d.day, "weekday": d.weekday(), "week": iso[1], "month": d.month, "year": d.year,
            "is_weekend": int(d.weekday() in weekend)}


def brute(features, predictor, start, end, clamp=True, anchor=None):
    rows = [r.asDict() for r in features.collect()]
    out = []
    for outlet in sorted({r["Outlet"] for r in rows}):
        g = sorted((r for r in rows if r["Outlet"] == outlet), key=lambda r: r["Date"])
        ga = [r for r in g if anchor is None or (r["Date"].year, r["Date"].month) == anchor]
        if not ga:
            continue
        last = ga[-1]
        hist = [r["Total Sales Amount"] for r in g if last["Date"] - 13 * DAY <= r["Date"] <= last["Date"]]
        if len(hist) < 7:
            continue
        d = max(last["Date"] + DAY, start) if clamp else last["Date"] + DAY
        st = {k: last[k] for k in ("lag_1", "lag_7", "lag_14", "ma_7", "ma_14")}
        while d <= end:
            x = dict(_calendar(d), **st)
            y = predictor.intercept
            for w, f in predictor.terms:
                y = None if (y is None or x[f] is None) else y + w * float(x[f])
            out.append((outlet, d, y))
            st["lag_14"], st["lag_7"], st["lag_1"] = st["lag_7"], st["lag_1"], y
            hist.append(y)
            if len(hist) > 14:
                hist.pop(0)
            last7, last14 = hist[-7:], hist[-14:]
            st["ma_7"] = None if None in last7 else sum(last7) / len(last7)
            st["ma_14"] = None if None in last14 else sum(last14) / len(last14)
            d += DAY
    return out


def _close(a, b):
    assert len(a) == len(b)
    for (o1, d1, y1), (o2, d2, y2) in zip(sorted(a, key=lambda r: (r[0], r[1])), sorted(b, key=lambda r: (r[0], r[1]))):
        assert (o1, d1) == (o2, d2)
        assert (y1 is None and y2 is None) or math.isclose(y1, y2, rel_tol=1e-12)


@pytest.mark.parametrize("predictor", [fc.BLEND, fc.WEEKLY])
@pytest.mark.parametrize("clamp,start", [(True, "2024-01-25"), (False, "2024-01-25"), (True, "2024-01-10")])
def test_fold_equals_brute_force(spark, predictor, clamp, start):
    f = feat.prepare_features(_tx(spark), drop_nans=False)
    spec = fc.ForecastSpec(start=start, end="2024-02-05", clamp_start=clamp)
    got = [tuple(r) for r in fc.predict_daily(f, spec, predictor).collect()]
    want = brute(f, predictor, ts(start), ts("2024-02-05"), clamp)
    _close(got, want)
    assert {o for o, _, _ in got} == {"A", "C"}           # B skipped (5 rows in lookback)


def test_anchor_period_script_dialect(spark):
    f = feat.prepare_features(_tx(spark), drop_nans=False)
    spec = fc.ForecastSpec(start="2024-02-01", end="2024-02-03", clamp_start=False, anchor_period={"year": 2024, "month": 1})
    got = [tuple(r) for r in fc.predict_daily(f, spec, fc.WEEKLY).collect()]
    _close(got, brute(f, fc.WEEKLY, ts("2024-02-01"), ts("2024-02-03"), clamp=False, anchor=(2024, 1)))


def test_empty_when_end_before_start(spark):
    f = feat.prepare_features(_tx(spark), drop_nans=False)
    spec = fc.ForecastSpec(start="2024-03-01", end="2024-02-01")
    assert fc.predict_daily(f, spec, fc.BLEND).count() == 0


def test_invariants_monthly_equals_daily_and_outlets_partition(spark):
    f = feat.prepare_features(_tx(spark), drop_nans=False)
    spec = fc.ForecastSpec(start="2024-01-21", end="2024-02-10")
    daily = fc.predict_daily(f, spec, fc.WEEKLY)
    monthly = sm.monthly_forecast(daily)
    a = {r[0]: r[1] for r in daily.groupBy("Outlet").agg(F.sum("Predicted Sales")).collect()}
    b = {r[0]: r[1] for r in monthly.groupBy("Outlet").agg(F.sum("Predicted Monthly Sales")).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)
    hist = fc.history_state(fc.recent_history(f, fc.last_row_per_outlet(f)))
    skipped = {r[0] for r in fc.skipped_outlets(hist).collect()}
    assert skipped == {"B"}
    assert set(a) | skipped == {"A", "B", "C"}


def test_state_history_is_bounded_to_last_14(spark):
    rows = [("A", ts("2024-01-01") + i * DAY, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    f = feat.prepare_features(df, drop_nans=False)
    st = fc.forecast_state(f, fc.ForecastSpec(start="2024-02-10", end="2024-02-12")).first()
    assert st["n_hist"] == 14 and st["hist"] == [float(i) for i in range(26, 40)]


def test_history_threshold_six_vs_seven_rows(spark):
    rows = [("six", ts("2024-01-01") + i * DAY, 10.0 + i) for i in range(6)]
    rows += [("seven", ts("2024-01-01") + i * DAY, 20.0 + i) for i in range(7)]
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    f = feat.prepare_features(df, drop_nans=False)
    out = fc.predict_daily(f, fc.ForecastSpec(start="2024-01-08", end="2024-01-09"), fc.WEEKLY)
    assert {r["Outlet"] for r in out.collect()} == {"seven"}
    hist = fc.history_state(fc.recent_history(f, fc.last_row_per_outlet(f)))
    assert [tuple(r) for r in fc.skipped_outlets(hist).collect()] == [("six", 6)]
