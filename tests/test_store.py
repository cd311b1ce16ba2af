import datetime as dt

import pytest

from dailycast.plans import jobs
from dailycast.session import scratch_path
from dailycast.sources import modelstore as ms
from dailycast.sources import testdata as td
from conftest import SF_SMALL, SF_MID


def test_registry_latest_wins_get_list_by_type(spark):
    root = scratch_path(spark, "reg")
    ms.register(spark, root, [{"model_type": "xgboost", "model_name": "full_data", "version": "1.0.0"}],
                now=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    ms.register(spark, root, [{"model_type": "xgboost", "model_name": "full_data", "version": "1.1.0"},
                              {"model_type": "catboost", "model_name": "jan_2025",
                               "training_period": {"year": 2025, "month": 1}}],
                now=dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc))
    reg = ms.read_registry(spark, root)
    assert [r[0] for r in ms.list_models(reg).collect()] == ["catboost_jan_2025", "xgboost_full_data"]
    assert ms.registry_get(reg, "xgboost", "full_data").first()["version"] == "1.1.0"
    assert ms.registry_get(reg, "xgboost", "absent").count() == 0
    assert ms.registry_by_type(reg, "catboost").count() == 1
    listed = {r["model_key"]: r["status"] for r in ms.list_models_with_metadata(reg, ms.read_metadata(spark, root)).collect()}
    assert listed == {"catboost_jan_2025": "unknown", "xgboost_full_data": "unknown"}


def test_training_and_forecast_jobs_round_trip(spark):
    root = scratch_path(spark, "store")
    tx = td.events_by_user(spark, SF_MID)
    info = jobs.training_job(spark, tx, root, "xgboost", hyperparams={"n_estimators": 3, "max_depth": 3},
                             now=dt.datetime(2024, 2, 1, 8, 30, 0))
    assert info["model_name"] == "xgboost_full_20240201_083000"
    listed = {r["model_key"]: r for r in ms.list_models_with_metadata(ms.read_registry(spark, root),
                                                                       ms.read_metadata(spark, root)).collect()}
    assert listed["xgboost_full_20240201_083000"]["status"] == "trained"
    out = jobs.forecast_job(spark, tx, root, info["model_name"], start="2024-01-31", end="2024-02-29",
                            write_monthly=True)
    assert out.predictions_count == 150 * 30
    assert spark.read.option("header", True).csv(out.monthly_path).count() == 300
    assert out.preview().count() == 100
    monthly = {(r["month"], r["outlet"]) for r in out.monthly.collect()}
    assert len(monthly) == 300
    one = jobs.forecast_job(spark, tx, root, info["model_name"], outlet="7", start="2024-01-31", end="2024-02-02")
    assert {r["outlet"] for r in one.daily.collect()} == {"7"} and one.predictions_count == 3
    hist = ms.prediction_history(spark, root).collect()
    # daily output, its monthly totals (write_monthly) and the one-outlet daily output
    assert [r["filename"] for r in hist] == sorted([r["filename"] for r in hist], reverse=True) and len(hist) == 3
    with pytest.raises(FileNotFoundError):
        jobs.forecast_job(spark, tx, root, "missing_model")
    with pytest.raises(ValueError):
        jobs.training_job(spark, tx, root, "lightgbm")
    status = jobs.training_status(spark, tx, root)
    assert status["models"] == ["xgboost_full_20240201_083000"] and status["last_training"] is None


def test_daily_data_query(spark):
    tx = td.retail_transactions(spark, SF_SMALL)
    out = jobs.daily_data_query(tx, outlet="NATION_3", start="1996-01-01", end="1996-12-31")
    rows = out.collect()
    assert out.columns == ["date", "outlet", "sales"]
    assert all(r["outlet"] == "NATION_3" and r["date"].year == 1996 for r in rows)


def test_jobs_named_period_and_empty_forecast(spark):
    root = scratch_path(spark, "store2")
    tx = td.events_by_user(spark, SF_SMALL)
    info = jobs.training_job(spark, tx, root, "catboost", training_period="3months",
                             hyperparams={"iterations": 2, "depth": 3}, now=dt.datetime(2024, 3, 1))
    assert info["model_name"] == "catboost_3months_20240301_000000" and info["training_period"] == "3months"
    out = jobs.forecast_job(spark, tx, root, info["model_name"], outlet="no-such-outlet",
                            start="2024-01-31", end="2024-02-05")
    assert out.predictions_count == 0 and out.monthly.count() == 0
    m = ms.model_metrics(spark, root, info["model_name"]).first()
    assert m["model_type"] == "catboost" and m["test_size"] >= 0 and len(m["features"]) == 12
    with pytest.raises(FileNotFoundError):
        ms.model_metrics(spark, root, "absent")
    assert out.daily.columns == ["outlet", "date", "prediction"]
