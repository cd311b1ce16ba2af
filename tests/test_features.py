import math

from pyspark.sql import functions as F

from dailycast.operators import features as feat
from dailycast.schema import WEEKEND_DAYS_FRIDAY_ONLY


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("Outlet", "Date").select(*cols).collect()]


def test_daily_sums_drop_null_keys_and_zero_for_all_null(tx):
    df = tx([("A", "2024-01-01", 10.0, 1.0), ("A", "2024-01-01", 5.5, None), (None, "2024-01-01", 3.0, 0.0),
             ("B", None, 4.0, 0.0), ("B", "2024-01-02", None, None)])
    out = rows(feat.daily_sales(df), "Outlet", "Total Sales Amount", "Total Discount")
    assert out == [("A", 15.5, 1.0), ("B", 0.0, 0.0)]


def test_grain_exact_keeps_times_day_truncates(tx):
    df = tx([("A", "2024-01-01 09:00:00", 1.0, 0.0), ("A", "2024-01-01 17:30:00", 2.0, 0.0)])
    assert feat.daily_sales(df, "exact").count() == 2
    day = feat.daily_sales(df, "day").collect()
    assert len(day) == 1 and day[0]["Total Sales Amount"] == 3.0


def test_missing_discount_column_is_zero(tx):
    df = tx([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0)], with_discount=False)
    assert {r["Total Discount"] for r in feat.daily_sales(df).collect()} == {0.0}


def test_calendar_iso_week_and_weekend_rules(tx):
    df = tx([("A", "2024-12-30", 1.0, 0.0), ("A", "2021-01-03", 1.0, 0.0), ("A", "2024-01-05", 1.0, 0.0),
             ("A", "2024-01-06", 1.0, 0.0), ("A", "2024-01-07", 1.0, 0.0), ("A", "2024-01-08", 1.0, 0.0)])
    lib = {r["Date"].date().isoformat(): r for r in feat.date_features(feat.daily_sales(df)).collect()}
    assert (lib["2024-12-30"]["week"], lib["2024-12-30"]["year"], lib["2024-12-30"]["weekday"]) == (1, 2024, 0)
    assert lib["2021-01-03"]["week"] == 53
    assert [lib[d]["is_weekend"] for d in ("2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08")] == [1, 1, 1, 0]
    fri = {r["Date"].date().isoformat(): r["is_weekend"]
           for r in feat.date_features(feat.daily_sales(df), WEEKEND_DAYS_FRIDAY_ONLY).collect()}
    assert [fri[d] for d in ("2024-01-05", "2024-01-06", "2024-01-07")] == [1, 0, 0]


def _series(tx, values, start_day=1, gap_at=None):
    out, day = [], start_day
    for i, v in enumerate(values):
        if gap_at is not None and i == gap_at:
            day += 5
        out.append(("A", f"2024-01-{day:02d}", float(v), 0.0))
        day += 1
    return tx(out)


def test_lags_are_row_shifts_and_ignore_calendar_gaps(tx):
    df = feat.lag_features(feat.daily_sales(_series(tx, range(1, 17), gap_at=3)))
    r = rows(df, "Total Sales Amount", "lag_1", "lag_7", "lag_14")
    assert r[3] == (4.0, 3.0, None, None)          # row after the 5-day gap: previous row
    assert r[14] == (15.0, 14.0, 8.0, 1.0)


def test_moving_average_partial_full_and_exclude_current(tx):
    d = feat.daily_sales(_series(tx, [1, 2, 3, 4, 5, 6, 7, 8]))
    part = rows(feat.lag_features(d), "ma_7")
    full = rows(feat.lag_features(d, full_window=True), "ma_7")
    excl = rows(feat.lag_features(d, exclude_current=True), "ma_7")
    assert part[0][0] == 1.0 and part[1][0] == 1.5 and part[7][0] == 5.0
    assert full[5][0] is None and full[6][0] == 4.0 and full[7][0] == 5.0
    assert excl[0][0] is None and excl[1][0] == 1.0 and excl[7][0] == 4.0


def test_prepare_features_drops_rows_with_nulls(tx):
    d = _series(tx, range(1, 21))
    assert feat.prepare_features(d).count() == 20 - 14
    assert feat.prepare_features(d, drop_nans=False).count() == 20
    assert feat.legacy_features(d).count() == 20 - 14


def test_nan_amount_counts_as_missing(tx, spark):
    df = tx([("A", "2024-01-01", float("nan"), 0.0), ("A", "2024-01-01", 2.0, 0.0)])
    assert feat.daily_sales(df).first()["Total Sales Amount"] == 2.0
    assert not math.isnan(feat.daily_sales(df).agg(F.sum("Total Sales Amount")).first()[0])


def test_block_layout_equals_window_layout(spark):
    import datetime as dt
    rng = __import__("random").Random(5)
    rows = []
    for o, n in (("hot", 300), ("b", 40), ("c", 9)):
        t = dt.datetime(2024, 1, 1)
        for _ in range(n):
            t += dt.timedelta(minutes=rng.randint(1, 600))
            rows.append((o, t, float(rng.randint(1, 500)) / 4))
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    d = feat.daily_sales(df)
    for kw in ({}, {"full_window": True}, {"exclude_current": True}):
        a = feat.lag_features(d, **kw)
        b = feat.lag_features(d, layout="blocks", block_rows=16, chunk_unit="HOUR", **kw)
        assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


def test_single_date_summary_has_null_std(tx):
    from dailycast.operators import summary as sm
    df = tx([("A", "2024-01-01", 10.0, 0.0), ("B", "2024-01-01", 5.0, 0.0), (None, "2024-01-01", 1.0, 0.0)])
    r = sm.data_summary(df).first()
    assert (r["total_records"], r["outlets"], r["average_sales"], r["std_dev"]) == (3, 2, 15.0, None)
    assert r["min_sales"] == r["max_sales"] == 15.0


def test_summary_of_empty_input(tx):
    from dailycast.operators import summary as sm
    df = tx([("A", "2024-01-01", 1.0, 0.0)]).limit(0)
    r = sm.data_summary(df).collect()
    assert len(r) == 1 and r[0]["total_records"] == 0 and r[0]["outlets"] == 0 and r[0]["average_sales"] is None


def test_auto_layout_picks_blocks_for_long_series(spark):
    import datetime as dt
    rows = [("hot", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 17)) for i in range(60)]
    rows += [("b", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0 + i) for i in range(5)]
    d = feat.daily_sales(spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double"))
    _, chosen = feat.choose_layout(d, max_window_rows=20)
    assert chosen == "blocks"
    assert feat.choose_layout(d)[1] == "window"
    a = feat.lag_features(d)
    b = feat.lag_features(d, layout="auto", max_window_rows=20, block_rows=16, chunk_unit="HOUR")
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
