"""Cases in which rows, digits or outlets could get lost."""

import datetime as dt

import pytest

from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.operators import metrics as mt
from dailycast.operators import split as sp
from dailycast.operators import summary as sm
from dailycast.plans import jobs
from dailycast.plans import train as trn
from dailycast.session import scratch_path
from dailycast.sources import modelstore as ms
from dailycast.sources import transactions as tr
from dailycast.streaming import daily as sd

DAY = dt.datetime(2024, 1, 1)
TX = "Outlet string, Date timestamp_ntz, `Total Sales Amount` double, `Total Discount` double"


def series(outlet, days, start=DAY, value=100.0):
    return [(outlet, start + dt.timedelta(days=i), value + i, 0.0) for i in range(days)]


def test_small_and_large_amounts_are_not_rounded(spark):
    rows = [("a", DAY, 0.004, 0.0)] * 1000 + [("b", DAY, 3e16, 0.0), ("c", DAY, 1.23456789, 0.12345678)]
    got = {r.Outlet: r for r in feat.daily_sales(spark.createDataFrame(rows, TX)).collect()}
    assert got["a"]["Total Sales Amount"] == 4.0
    assert got["b"]["Total Sales Amount"] == 3e16
    assert (got["c"]["Total Sales Amount"], got["c"]["Total Discount"]) == (1.23456789, 0.12345678)


def test_job_forecasts_an_outlet_with_a_short_history(spark):
    tx = spark.createDataFrame(series("long", 40) + series("short", 10, DAY + dt.timedelta(days=30), -500.0), TX)
    root = scratch_path(spark, "job")
    info = jobs.training_job(spark, tx, root, "xgboost", "jan_2024", hyperparams={"n_estimators": 2, "max_depth": 3},
                             now=dt.datetime(2024, 3, 1))
    out = jobs.forecast_job(spark, tx, root, info["model_name"], start="2024-02-10", end="2024-02-12")
    assert {r.outlet for r in out.daily.collect()} == {"long", "short"}
    m = ms.model_metrics(spark, root, info["model_name"]).first()
    assert (m["training_period"]["year"], m["training_period"]["month"]) == (2024, 1)
    assert (m["data_range"]["train_start"], m["data_range"]["train_end"]) == (DAY, DAY + dt.timedelta(days=39))
    reg = ms.read_registry(spark, root).first()
    assert (reg["training_period"]["year"], reg["training_period"]["month"]) == (2024, 1)
    fill = float(ms.read_metadata(spark, root).first()["hyperparameters"]["null_sentinel"])
    assert fill < -500.0                                 # below every value, net refunds included
    assert m["test_size"] == 7                           # 32 January rows, those without full lags included


def test_fit_on_all_rows(spark):
    f = feat.prepare_features(spark.createDataFrame(series("a", 60), TX))
    res = trn.train(f, "xgboost", hyperparams={"n_estimators": 2, "max_depth": 2}, test_size=0.0)
    assert res.metrics["test_size"] == 0 and res.metrics["rmse"] is None


def test_month_only_anchor_finds_the_month(spark):
    f = feat.prepare_features(spark.createDataFrame(series("a", 60), TX), drop_nans=False)
    state = fc.forecast_state(f, fc.ForecastSpec(start="2024-03-10", end="2024-03-11", anchor_period={"month": 1})).collect()
    assert [r.Date for r in state] == [r.Date for r in fc.last_row_per_outlet(f, {"month": 1}).collect()] == [dt.datetime(2024, 1, 31)]


def test_last_months_keep_the_time_of_day(spark):
    rows = [("a", dt.datetime(2024, 1, 15, 9), 1.0, 0.0), ("a", dt.datetime(2024, 4, 15, 10), 1.0, 0.0)]
    assert sp.resolve_named_period(spark.createDataFrame(rows, TX), "3months").count() == 1


def test_winner_is_decided_before_rounding(spark):
    df = spark.createDataFrame([(1.0, 1.00001, 1.00002), (2.0, 2.0, 2.0)], "`Total Sales Amount` double, p double, q double")
    assert {r.winner for r in mt.compare_models(df, {"p": "p", "q": "q"}, digits=2).collect()} == {"p"}


def test_stratified_share_of_the_whole(spark):
    rows = [r for k in range(40) for r in series(f"o{k}", 7)] + series("single", 1)
    got = sp.stratified_split(spark.createDataFrame(rows, TX), 0.2).groupBy("Outlet", "split").count().collect()
    assert sum(r["count"] for r in got if r.split == "test") == 57      # ceil(281 / 5)
    assert {r.Outlet for r in got if r.split == "train"} == {f"o{k}" for k in range(40)} | {"single"}


def test_equal_registry_times_have_one_winner(spark):
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [ms.registry_rows(spark, [{"model_type": "xgboost", "model_name": "m", "version": v}], now) for v in ("1.0", "2.0")]
    for a, b in (rows, rows[::-1]):
        assert [r.version for r in ms.latest_per_key(a.union(b)).collect()] == ["2.0"]


def test_history_lists_an_empty_forecast(spark):
    root = scratch_path(spark, "predictions") + "/store"
    frame = spark.createDataFrame([("a", DAY, 1.0)], "outlet string, date timestamp_ntz, prediction double")
    ms.write_table(frame, f"{root}/predictions/full.csv")
    ms.write_table(frame.limit(0), f"{root}/predictions/none.csv")
    assert [r.filename for r in ms.prediction_history(spark, root).collect()] == ["none.csv", "full.csv"]


def test_stream_table_before_its_first_batch(spark):
    got = sd.read_daily(spark, scratch_path(spark, "absent"))
    assert got.count() == 0 and got.columns == feat.daily_sales(spark.createDataFrame([], TX)).columns


def test_files_with_another_column_order_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Outlet,Date,Total Sales Amount,Total Discount\nx,2024-01-01,5,1\n")
    assert tr.load_transactions(spark, str(tmp_path)).first()["Total Sales Amount"] == 5
    (tmp_path / "b.csv").write_text("Outlet,Date,Total Discount,Total Sales Amount\nx,2024-01-01,1,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        tr.load_transactions(spark, str(tmp_path)).collect()


def test_date_format(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Outlet,Date,Total Sales Amount\nx,1/31/2025,5\n")
    assert tr.load_transactions(spark, str(tmp_path), fmt="M/d/yyyy").first()["Date"] == dt.datetime(2025, 1, 31)


def test_pivot_months_come_from_the_horizon(spark):
    assert fc.ForecastSpec("2024-11-20", "2025-02-03").months() == ["2024-11", "2024-12", "2025-01", "2025-02"]
    monthly = spark.createDataFrame([("a", "2024-12", 1.0)], "Outlet string, Month string, `Predicted Monthly Sales` double")
    assert sm.outlet_month_series(monthly, ["2024-11", "2024-12"]).first().asDict() == {"Outlet": "a", "2024-11": None, "2024-12": 1.0}
