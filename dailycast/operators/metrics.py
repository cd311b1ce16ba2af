"""Model evaluation and comparison.

Metrics are one-pass aggregates: a partial aggregate per partition and one
tiny final merge, never a collect of predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.functions.columns import money, safe_ratio
from dailycast.schema import OUTLET, TARGET

PREDICTION = "prediction"


def _r2(ss_res: Column, ss_tot: Column) -> Column:
    """1 - SS_res/SS_tot; a constant target gives 1.0 when the fit is
    perfect and 0.0 otherwise (the scikit-learn convention)."""
    return (F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - safe_ratio(ss_res, ss_tot)))


def _metric_aggs(y: Column, p: Column, prefix: str = "") -> list[Column]:
    e = y - p
    return [
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        F.avg(e * e).alias(f"{prefix}mse"),
        F.sum(e * e).alias(f"{prefix}ss_res"),
    ]


def _finish(prefix: str, digits: int | None) -> dict[str, Column]:
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    mae, mse, ss_res = (F.col(f"{prefix}{k}") for k in ("mae", "mse", "ss_res"))
    return {
        f"{prefix}mae": r(mae),
        f"{prefix}rmse": r(F.sqrt(mse)),
        f"{prefix}r2": r(_r2(ss_res, F.col("_ss_tot"))),
    }


def evaluate(pred: DataFrame, label: str = TARGET, prediction: str = PREDICTION,
             digits: int | None = None) -> DataFrame:
    """``mae, rmse, r2, test_size`` of one prediction column (one row)."""
    y, p = F.col(label), F.col(prediction)
    row = pred.agg(*_metric_aggs(y, p), (F.var_pop(y) * F.count(y)).alias("_ss_tot"),
                   F.count(F.lit(1)).alias("test_size"))
    fin = _finish("", digits)
    return row.select(fin["mae"].alias("mae"), fin["rmse"].alias("rmse"), fin["r2"].alias("r2"), "test_size")


def compare_models(pred: DataFrame, predictions: Mapping[str, str], label: str = TARGET,
                   digits: int | None = None) -> DataFrame:
    """The same metrics for several prediction columns on the same rows
    (one aggregate pass), one output row per model, plus the winner by lower
    RMSE (``similar`` when the best RMSE is shared)."""
    y = F.col(label)
    names = list(predictions)
    aggs = [(F.var_pop(y) * F.count(y)).alias("_ss_tot"), F.count(F.lit(1)).alias("test_size")]
    for i, name in enumerate(names):
        aggs += _metric_aggs(y, F.col(predictions[name]), prefix=f"m{i}_")
    wide = pred.agg(*aggs)
    cols = {}
    for i in range(len(names)):
        cols.update(_finish(f"m{i}_", None))
    wide = wide.withColumns(cols)          # the winner is decided on these; rounding is for the output
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    rmses = [F.col(f"m{i}_rmse") for i in range(len(names))]
    best = F.least(*rmses) if len(rmses) > 1 else rmses[0]
    n_best = sum((F.when(r == best, 1).otherwise(0) for r in rmses), F.lit(0))
    winner = F.when(n_best > 1, F.lit("similar"))
    for i, name in enumerate(names):
        winner = winner.when(rmses[i] == best, F.lit(name))
    wide = wide.withColumn("winner", winner)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("Model"), r(F.col(f"m{i}_mae")).alias("MAE"),
                 r(F.col(f"m{i}_rmse")).alias("RMSE"), r(F.col(f"m{i}_r2")).alias("r2"))
        for i, name in enumerate(names)]))
    return wide.select(stacked.alias("m"), "test_size", "winner").select("m.*", "test_size", "winner")


def error_reduction(comparison: DataFrame, base: str, other: str, digits: int | None = None) -> DataFrame:
    """Percent MAE and RMSE reduction of ``other`` against ``base``, the
    R2 difference, and the better model by MAE (a tie goes to ``base``).

    ``comparison`` is the long output of :func:`compare_models`; the pivot
    reads its (tiny, one row per model) rows in one aggregate."""
    def pick(model, col):
        return F.max(F.when(F.col("Model") == model, F.col(col)))
    wide = comparison.agg(pick(base, "MAE").alias("b_mae"), pick(other, "MAE").alias("o_mae"),
                          pick(base, "RMSE").alias("b_rmse"), pick(other, "RMSE").alias("o_rmse"),
                          pick(base, "r2").alias("b_r2"), pick(other, "r2").alias("o_r2"))
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    mae_red = safe_ratio(F.col("b_mae") - F.col("o_mae"), F.col("b_mae")) * 100
    rmse_red = safe_ratio(F.col("b_rmse") - F.col("o_rmse"), F.col("b_rmse")) * 100
    return wide.select(
        F.lit(base).alias("base_model"), F.lit(other).alias("other_model"),
        r(mae_red).alias("mae_reduction_pct"), r(rmse_red).alias("rmse_reduction_pct"),
        r(F.col("o_r2") - F.col("b_r2")).alias("r2_improvement"),
        F.when(mae_red > 0, F.lit(other)).otherwise(F.lit(base)).alias("better_model"),
    )


def actual_vs_predicted(pred: DataFrame, label: str = TARGET, prediction: str = PREDICTION,
                        digits: int | None = None) -> DataFrame:
    """Per outlet, actual and predicted totals on the evaluated rows."""
    p = F.sum(prediction)
    return pred.groupBy(OUTLET).agg(
        F.sum(money(label)).cast("double").alias("Actual Sales"),
        (p if digits is None else F.round(p, digits)).alias("Predicted Sales"),
    )
