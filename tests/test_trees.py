"""Tree scoring in numpy against Spark ML, and the batched tree forecast
against a day-by-day loop that calls ``model.transform`` (one job per day)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.plans import train as trn
from dailycast.plans import tree_forecast as tf
from dailycast.schema import FEATURES
from conftest import ts

DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def feats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for o in ["s1", "s2", "s3", "s4", "s5", "s6"]:
        base = rng.uniform(50, 150)
        for i in range(45):
            d = ts("2024-01-01") + i * DAY
            rows.append((o, d, float(round(base + 20 * (d.weekday() >= 4) + rng.normal(0, 5), 2))))
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    return feat.prepare_features(df, drop_nans=False).cache()


@pytest.fixture(scope="module", params=["xgboost", "catboost"])
def fitted(request, feats):
    return trn.train(feats, request.param, hyperparams={"n_estimators": 6, "iterations": 6, "depth": 4, "max_depth": 4})


def test_numpy_ensemble_equals_spark_ml(spark, feats, fitted):
    ens = tf.TreeEnsemble.from_gbt(spark, fitted.gbt)
    scored = fitted.model.transform(trn.handle_nulls(feats, "drop"))
    pdf = scored.select(vector_to_array(F.col("features")).alias("v"), "prediction").toPandas()
    got = ens.predict(np.stack(pdf["v"].to_numpy()))
    assert np.allclose(got, pdf["prediction"].to_numpy(), rtol=1e-12, atol=1e-9)
    if fitted.model_type == "catboost":
        assert len(ens.cat_keys) > 0


def _loop_with_transform(spark, feats, model, start, end):
    """Path B: one model.transform per day on one row per outlet."""
    state = fc.forecast_state(feats, fc.ForecastSpec(start=start, end=end)).toPandas()
    out = []
    for _, s in state.iterrows():
        cur = {k: s[k] for k in ("lag_1", "lag_7", "lag_14", "ma_7", "ma_14")}
        hist = list(s["hist"])
        d = s["pred_start"].to_pydatetime()
        while d <= ts(end):
            iso = d.isocalendar()
            row = dict(Outlet=s["Outlet"], Date=d, day=d.day, weekday=d.weekday(), week=iso[1], month=d.month,
                       year=d.year, is_weekend=int(d.weekday() >= 4), **{k: float(v) for k, v in cur.items()})
            row["Total Sales Amount"] = 0.0
            one = spark.createDataFrame([row])
            y = model.transform(one).first()["prediction"]
            out.append((s["Outlet"], d, y))
            cur["lag_14"], cur["lag_7"], cur["lag_1"] = cur["lag_7"], cur["lag_1"], y
            hist = (hist + [y])[-14:]
            cur["ma_7"], cur["ma_14"] = float(np.mean(hist[-7:])), float(np.mean(hist))
            d += DAY
    return out


def test_tree_forecast_equals_day_by_day_transform(spark, feats, fitted):
    start, end = "2024-02-15", "2024-02-18"
    got = sorted(tuple(r) for r in tf.forecast_with_trees(feats, fitted.model, fc.ForecastSpec(start=start, end=end)).collect())
    want = sorted(_loop_with_transform(spark, feats, fitted.model, start, end))
    assert [(o, d) for o, d, _ in got] == [(o, d) for o, d, _ in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want))


def test_importance_and_early_stopping(spark, feats):
    res = trn.train(feats, "xgboost", hyperparams={"n_estimators": 8, "max_depth": 3}, early_stopping=2)
    assert len(res.iteration_errors) == 8 and res.best_iteration is not None
    assert res.gbt.getNumTrees == res.best_iteration + 1 or res.best_iteration + 1 == len(res.iteration_errors)
    imp = trn.feature_importance(spark, res, 5).collect()
    assert len(imp) == 5 and {r["feature"] for r in imp} <= set(FEATURES)
    assert imp[0]["importance"] >= imp[-1]["importance"]


def test_best_iteration_patience():
    assert trn.best_iteration([5, 4, 3, 3.5, 3.6, 3.7, 2.0], patience=3) == 2
    assert trn.best_iteration([5, 4, 3, 3.5, 3.6, 2.0], patience=3) == 5


def test_hyperparameter_names_map():
    ref, sparkp = trn.gbt_params("xgboost", {"xgboost_max_depth": 3, "n_estimators": 7})
    assert ref["max_depth"] == 3 and sparkp["maxDepth"] == 3 and sparkp["maxIter"] == 7
    assert sparkp["subsamplingRate"] == 0.8 and sparkp["featureSubsetStrategy"] == "0.8"
    with pytest.raises(ValueError):
        trn.gbt_params("lightgbm")
    with pytest.raises(ValueError):
        trn.gbt_params("xgboost", {"no_such_param": 1})


def test_train_with_stratified_split_uses_exact_quota(spark, feats):
    import math as _m
    res = trn.train(feats, "xgboost", hyperparams={"n_estimators": 2, "max_depth": 3}, split="stratified")
    assert res.metrics["test_size"] == _m.ceil(trn.handle_nulls(feats, "drop").count() * 0.2)
    with pytest.raises(ValueError):
        trn.train(feats, "xgboost", split="random")


def test_train_profiles_concurrently(spark, feats):
    out = trn.train_profiles(feats, hyperparams={"n_estimators": 2, "iterations": 2, "max_depth": 3, "depth": 3})
    assert set(out) == {"catboost", "xgboost"}
    assert all(r.metrics["test_size"] > 0 for r in out.values())
    assert out["catboost"].model_type == "catboost" and len(out["catboost"].gbt.trees) == 2
