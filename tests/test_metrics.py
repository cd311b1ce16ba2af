import math

import numpy as np

from dailycast.operators import metrics as mt


def _pred(spark, y, p, q=None):
    rows = [("A", float(a), float(b), float(c if q else 0.0)) for a, b, c in zip(y, p, q or p)]
    return spark.createDataFrame(rows, "Outlet string, `Total Sales Amount` double, prediction double, other double")


def test_evaluate_matches_formulas(spark):
    y = np.array([10.0, 12.0, 9.0, 15.0, 11.0])
    p = np.array([11.0, 11.0, 10.0, 13.0, 11.5])
    r = mt.evaluate(_pred(spark, y, p)).first()
    assert math.isclose(r["mae"], np.mean(np.abs(y - p)))
    assert math.isclose(r["rmse"], np.sqrt(np.mean((y - p) ** 2)))
    assert math.isclose(r["r2"], 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    assert r["test_size"] == 5


def test_constant_target_r2(spark):
    assert mt.evaluate(_pred(spark, [5, 5, 5], [5, 5, 5])).first()["r2"] == 1.0
    assert mt.evaluate(_pred(spark, [5, 5, 5], [4, 5, 6])).first()["r2"] == 0.0


def test_compare_winner_and_tie(spark):
    df = _pred(spark, [1, 2, 3], [1, 2, 4], [1, 2, 3])
    out = {r["Model"]: r for r in mt.compare_models(df, {"a": "prediction", "b": "other"}).collect()}
    assert out["a"]["winner"] == "b"
    tie = mt.compare_models(df, {"a": "prediction", "b": "prediction"}).first()
    assert tie["winner"] == "similar"


def test_error_reduction_tie_goes_to_base(spark):
    df = _pred(spark, [1, 2, 3], [1, 2, 4], [1, 2, 4])
    cmp = mt.compare_models(df, {"base": "prediction", "other": "other"})
    r = mt.error_reduction(cmp, "base", "other").first()
    assert r["mae_reduction_pct"] == 0.0 and r["better_model"] == "base"
