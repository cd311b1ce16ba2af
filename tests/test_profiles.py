"""The model profiles on the library's own booster, and the outlet encodings behind them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.operators import encoding
from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.operators import split as sp
from dailycast.operators.prefix import sums_before
from dailycast.plans import jobs, profiles
from dailycast.plans import train as trn
from dailycast.plans import tree_forecast as tf
from dailycast.schema import FEATURES, NUMERIC_FEATURES
from dailycast.session import scratch_path
from dailycast.sources import modelstore as ms
from conftest import ts

SMALL = {"n_estimators": 12, "iterations": 12, "depth": 4, "max_depth": 4, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k, o in enumerate(["s1", "s2", "s3", "s4"]):
        for i in range(50):
            d = ts("2024-01-01") + i * dt.timedelta(days=1)
            rows.append((o, d, float(round(100 + 40 * k + 25 * (d.weekday() >= 4) + rng.normal(0, 5), 2)), 0.0))
    return spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double, `Total Discount` double").cache()


@pytest.fixture(scope="module")
def feats(sales):
    return feat.prepare_features(sales, drop_nans=False).cache()


@pytest.fixture(scope="module", params=["xgboost", "catboost"])
def result(request, feats):
    return trn.train(feats, request.param, hyperparams=SMALL, nulls="keep", engine="histogram")


def test_profiles_keep_null_rows_and_beat_the_mean(feats, result):
    test = sp.time_split(feats).where("split = 'test'")
    assert result.metrics["test_size"] == test.count() == 40
    assert result.metrics["r2"] > 0.5 and len(result.iteration_errors) == 12
    scored = trn.predict(result.model, feats)
    assert scored.count() == feats.count() == 200 and scored.where("prediction IS NULL").count() == 0
    assert feats.where("lag_14 IS NULL").count() > 0 and "outlet_value" not in scored.columns
    imp = trn.feature_importance(feats.sparkSession, result, 12).collect()
    assert {r.feature for r in imp} == set(FEATURES) and sum(r.importance for r in imp) == pytest.approx(1)
    assert result.metadata["hyperparameters"]["engine"] == "histogram"


def test_unseen_outlets(spark, feats, result):
    other = feats.limit(3).withColumn("Outlet", F.lit("new"))
    if result.model_type == "catboost":
        assert result.model.unseen == pytest.approx(encoding.target_prior(sp.time_split(feats).where("split = 'train'")))
        assert trn.predict(result.model, other).count() == 3
    else:
        with pytest.raises(Exception, match="unseen outlet: new"):
            trn.predict(result.model, other).collect()


def test_forecast_equals_a_day_by_day_loop(spark, feats, result):
    spec = fc.ForecastSpec(start="2024-02-20", end="2024-02-22")
    got = {(r["Outlet"], r["Date"]): r["Predicted Sales"] for r in tf.forecast_with_trees(feats, result.model, spec).collect()}
    assert len(got) == 12
    state = {r["Outlet"]: r.asDict() for r in fc.forecast_state(feats, spec).collect()}
    for day in range(20, 23):
        d = ts(f"2024-02-{day}")
        cal = {"day": d.day, "weekday": d.weekday(), "week": d.isocalendar()[1], "month": 2, "year": 2024, "is_weekend": int(d.weekday() >= 4)}
        rows = [(o, d, *(float(cal[c] if c in cal else s[c]) for c in NUMERIC_FEATURES)) for o, s in state.items()]
        frame = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, " + ", ".join(f"{c} double" for c in NUMERIC_FEATURES))
        for r in result.model.transform(frame).collect():
            s, y = state[r["Outlet"]], r["prediction"]
            assert got[r["Outlet"], d] == pytest.approx(y, abs=1e-9)
            hist = [*s["hist"], y][-14:]
            s.update(lag_14=s["lag_7"], lag_7=s["lag_1"], lag_1=y, hist=hist, ma_7=sum(hist[-7:]) / len(hist[-7:]), ma_14=sum(hist) / len(hist))


def test_saved_profile_forecasts_the_same_by_job(spark, sales):
    root = scratch_path(spark, "store")
    info = jobs.training_job(spark, sales, root, "xgboost", hyperparams=SMALL, now=dt.datetime(2024, 3, 1), nulls="keep", engine="histogram")
    model, meta = ms.load_model(spark, root, info["model_name"])
    assert isinstance(model, profiles.BoostedModel) and meta["hyperparameters"]["n_estimators"] == "12"
    out = jobs.forecast_job(spark, sales, root, info["model_name"], start="2024-02-20", end="2024-02-25")
    assert out.predictions_count == 24 and out.daily.where("prediction IS NULL").count() == 0


def test_early_stopping_records_the_kept_rounds(feats):
    res = trn.train(feats, "xgboost", hyperparams={**SMALL, "n_estimators": 60}, nulls="keep", engine="histogram", early_stopping=3)
    errors = res.iteration_errors
    assert res.best_iteration == trn.best_iteration(errors, 3) and res.model.boosted.trees.n_trees == res.best_iteration + 1
    assert res.metadata["hyperparameters"]["n_estimators"] == str(res.best_iteration + 1)
    assert res.metrics["rmse"] == pytest.approx(errors[res.best_iteration], abs=1e-6)


def test_parameters():
    p = profiles.boost_params("xgboost", trn.gbt_params("xgboost", {"xgboost_max_depth": 3})[0])
    assert (p.rounds, p.depth, p.learning_rate, p.subsample, p.colsample, p.reg_alpha, p.reg_lambda, p.symmetric) == (1000, 3, .05, .8, .8, .5, .5, False)
    p = profiles.boost_params("catboost", trn.gbt_params("catboost")[0])
    assert (p.rounds, p.depth, p.reg_lambda, p.symmetric) == (1000, 8, profiles.CATBOOST_L2, True)
    with pytest.raises(ValueError):
        profiles.boost_params("xgboost", {"no_such": 1})
    with pytest.raises(ValueError):
        profiles.boost_params("xgboost", {"max_bin": 1000})


def test_ordered_statistic_sees_earlier_rows_only(spark, feats):
    rows = feats.select("Outlet", "Date", "Total Sales Amount").collect()
    prior = sum(r[2] for r in rows) / len(rows)
    got = {(r["Outlet"], r["Date"]): r["outlet_value"] for r in encoding.ordered_statistic(feats, encoding.target_prior(feats)).collect()}
    for o, d, _ in rows:
        before = [r[2] for r in rows if r[0] == o and r[1] < d]
        assert got[o, d] == pytest.approx((sum(before) + prior) / (len(before) + 1), abs=1e-6)


def test_running_sums_of_a_hot_group_spread_over_partitions(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(None, i, 1) for i in range(5)] + [("b", 1, 4), ("b", 1, 5), ("a", 9, None)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    out = sums_before(df, "g", ["o"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    assert len(out) == len(rows)
    for r in (r for r in out if r.g == "hot"):
        assert (r.s, r.n) == (sum(i % 7 for i in range(r.o)), r.o)
    assert sorted(r.n for r in out if r.g is None) == list(range(5)) and sorted((r.s, r.n) for r in out if r.g == "b") == [(0, 0), (4, 1)]


def test_outlet_codes_and_salted_join(spark):
    a = spark.createDataFrame([("z",), ("b",), (None,), ("b",)], "Outlet string")
    b = spark.createDataFrame([("m",), ("é",)], "Outlet string")
    codes = {r["Outlet"]: r["outlet_value"] for r in encoding.outlet_codes(a, b).collect()}
    assert codes == {"b": 0.0, "m": 1.0, "z": 2.0, "é": 3.0}
    rows = spark.createDataFrame([("z", ts("2024-01-01")), ("z", ts("2024-01-02")), ("m", None)], "Outlet string, Date timestamp_ntz")
    assert sorted(r["outlet_value"] for r in encoding.attach(rows, encoding.outlet_codes(a, b)).collect()) == [1.0, 2.0, 2.0]
    with pytest.raises(Exception, match="unseen outlet"):
        encoding.attach(rows, encoding.outlet_codes(a)).collect()
    assert encoding.outlet_codes(a.limit(0)).count() == 0
