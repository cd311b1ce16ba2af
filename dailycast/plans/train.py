"""Model training on the feature table with Spark ML boosted trees
(M5-M11, M14, A9 inputs).

Two profiles reproduce the reference's two model families on one engine
(``GBTRegressor``):

* ``catboost`` -- Outlet is a *nominal* feature (its indexer metadata flows
  through ``VectorAssembler``, so trees split on category sets);
* ``xgboost``  -- Outlet is its sorted-label code used as a number, with
  row subsampling 0.8 and feature subsampling 0.8.

Spark's GBT has no L1/L2 leaf penalties: ``reg_alpha`` / ``reg_lambda`` are
recorded in the metadata but have no Spark counterpart.  ``engine="histogram"``
fits the same profiles with the library's own booster (``plans.profiles``), which
applies them, takes NULL features as they are and stops early within one fit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.columns import epoch_micros
from dailycast.plans import profiles
from dailycast.plans.profiles import BoostedModel
from dailycast.session import materialize
from dailycast.operators.metrics import evaluate
from dailycast.operators.select import period_condition
from dailycast.operators.split import (
    OUTLET_CODE,
    SPLIT,
    counted_quantile,
    fit_outlet_encoder,
    outlet_union,
    period_split,
    stratified_split,
)
from dailycast.schema import (
    CATBOOST_DEFAULTS,
    DATE,
    DEFAULT_SEED,
    DEFAULT_TEST_SIZE,
    DEFAULT_TOP_FEATURES,
    EARLY_STOPPING_PATIENCE,
    FEATURES,
    MODEL_TYPES,
    NUMERIC_FEATURES,
    OUTLET,
    TARGET,
    XGBOOST_DEFAULTS,
)

VECTOR = "features"
PREDICTION = "prediction"
OUTLET_NUM = "Outlet_num"
NULL_SENTINEL = -1.0   # default fill of NULL features; training measures one below every value instead
# A nominal split needs maxBins >= #categories, and split statistics grow with
# bins x nodes per level; beyond this many outlets use the numeric code.
MAX_NOMINAL_OUTLETS = 4096

# Reference hyper-parameter names -> GBTRegressor params (both naming families).
_NAME_MAP = {
    "iterations": "maxIter", "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "depth": "maxDepth", "max_depth": "maxDepth",
    "random_seed": "seed", "random_state": "seed",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
}
_IGNORED = {"loss_function", "eval_metric", "verbose", "verbosity", "reg_alpha", "reg_lambda"}
_SPARK_PARAMS = {"maxIter", "stepSize", "maxDepth", "seed", "subsamplingRate", "featureSubsetStrategy",
                 "minInstancesPerNode", "maxBins", "minInfoGain", "lossType", "checkpointInterval",
                 "cacheNodeIds", "maxMemoryInMB", "impurity", "validationTol", "minWeightFractionPerNode"}


def default_hyperparams(model_type: str) -> dict:
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}; known: {', '.join(MODEL_TYPES)}")
    return dict(CATBOOST_DEFAULTS if model_type == "catboost" else XGBOOST_DEFAULTS)


def gbt_params(model_type: str, hyperparams: Mapping | None = None) -> tuple[dict, dict]:
    """M7: defaults overlaid by ``hyperparams``; returns (effective reference
    params, GBTRegressor params).  Accepts the reference's names, the
    registry's prefixed names (``xgboost_max_depth``) and Spark's names."""
    params = default_hyperparams(model_type)
    for k, v in (hyperparams or {}).items():
        for prefix in ("catboost_", "xgboost_"):
            if k.startswith(prefix):
                k = k[len(prefix):]
        params[k] = v
    spark_params: dict = {"lossType": "squared"}
    for k, v in params.items():
        if k in _IGNORED:
            continue
        name = _NAME_MAP.get(k, k)
        if name not in _SPARK_PARAMS:
            raise ValueError(f"Unknown hyper-parameter: {k}")
        if name == "featureSubsetStrategy":
            v = str(v) if not isinstance(v, str) else v
        elif name == "minInstancesPerNode":
            v = max(1, int(v))
        elif name in ("maxIter", "maxDepth", "seed", "maxBins"):
            v = int(v)
        elif name in ("stepSize", "subsamplingRate"):
            v = float(v)
        spark_params[name] = v
    return params, spark_params


def handle_nulls(df: DataFrame, nulls: str, sentinel: float = NULL_SENTINEL) -> DataFrame:
    """Spark trees reject NULL/NaN features: ``drop`` the rows or fill with
    ``sentinel`` (a value below every feature value goes left at every split).
    ``keep`` leaves them, for the booster that learns their side."""
    cols = [c for c in NUMERIC_FEATURES if c in df.columns]
    if nulls == "drop":
        return df.na.drop("any", subset=cols + [TARGET])
    if nulls == "sentinel":
        return df.na.fill(sentinel, subset=cols).na.drop("any", subset=[TARGET])
    if nulls == "keep":
        return df.na.drop("any", subset=[TARGET])
    raise ValueError("nulls must be 'drop', 'sentinel' or 'keep'")


def build_pipeline(model_type: str, encoder: StringIndexerModel, spark_params: Mapping) -> Pipeline:
    """Encoder -> [numeric code] -> VectorAssembler(12 features) -> GBT."""
    stages = [encoder]
    if model_type == "catboost":
        if len(encoder.labels) > MAX_NOMINAL_OUTLETS:
            raise ValueError(f"{len(encoder.labels)} outlets exceed {MAX_NOMINAL_OUTLETS} for a nominal Outlet "
                             "feature; use the 'xgboost' profile (numeric outlet code)")
        outlet_col = OUTLET_CODE          # nominal: indexer metadata is kept
        params = dict(spark_params)
        params["maxBins"] = max(int(params.get("maxBins", 32)), len(encoder.labels))
    else:
        outlet_col = OUTLET_NUM           # plain number: metadata dropped
        stages.append(SQLTransformer(statement=f"SELECT *, {OUTLET_CODE} * 1.0 AS {OUTLET_NUM} FROM __THIS__"))
        params = dict(spark_params)
    stages.append(VectorAssembler(inputCols=[outlet_col] + NUMERIC_FEATURES, outputCol=VECTOR,
                                  handleInvalid="error"))
    stages.append(GBTRegressor(featuresCol=VECTOR, labelCol=TARGET, predictionCol=PREDICTION, **params))
    return Pipeline(stages=stages)


@dataclass
class TrainResult:
    model: PipelineModel | BoostedModel
    model_type: str
    metrics: dict
    metadata: dict
    hyperparameters: dict
    best_iteration: int | None = None
    iteration_errors: list = field(default_factory=list)
    sentinel: float = NULL_SENTINEL

    @property
    def gbt(self) -> GBTRegressionModel:
        return self.model.stages[-1]

    @property
    def encoder(self) -> StringIndexerModel:
        return self.model.stages[0]


def _kept(nulls: str):
    cols = [F.col(c) for c in NUMERIC_FEATURES] + [F.col(TARGET)]
    if nulls in ("sentinel", "keep"):
        cols = [F.col(TARGET)]
    cond = F.lit(True)
    for c in cols:
        cond = cond & c.isNotNull() & ~F.isnan(c)
    return cond


def _prepare(features: DataFrame, train_period, test_period, test_size, nulls, split_kind="time",
             seed: int = DEFAULT_SEED, materialize_input: bool = True):
    """M9 data preparation: NULL policy -> [period filter] -> split.

    The input is written once as a reliable checkpoint in the shared
    checkpoint folder: the many passes of boosting read it, and a lost
    executor re-reads files instead of recomputing the feature pipeline from
    the raw transactions.  One aggregate over it yields the cutoff quantile
    over the rows that are kept and the Date bounds of the whole input (as
    the run metadata reports them)."""
    base = materialize(features) if materialize_input else features
    period = period_condition(**train_period) if (train_period and not test_period) else F.lit(True)
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in NUMERIC_FEATURES if c in base.columns]
    per_date = base.groupBy(DATE).agg(
        F.count(F.when(_kept(nulls) & period, F.lit(1))).alias("n"), F.min(F.least(*values)).alias("low"))
    micros = epoch_micros(DATE)
    stats = per_date.agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"), F.min("low").alias("low")).first()
    sentinel = min(NULL_SENTINEL, float(stats["low"]) - 1.0) if stats["low"] is not None else NULL_SENTINEL
    df = handle_nulls(base, nulls, sentinel)
    if test_period:
        split = period_split(df, train_period, test_period)
    elif split_kind == "stratified":
        split = stratified_split(df.where(period), test_size, seed)
    else:
        df = df.where(period)
        cut = counted_quantile(per_date.where("n > 0"), 1.0 - test_size).first()[0] if test_size else None
        if cut is None:        # no hold-out: fit on every row
            split = df.withColumn(SPLIT, F.lit("train"))
        else:
            split = df.withColumn(SPLIT, F.when(micros < F.lit(cut), "train").otherwise("test"))
    return base, split, (stats["a"], stats["b"]), sentinel


def best_iteration(errors: list[float], patience: int = EARLY_STOPPING_PATIENCE) -> int:
    """M8: index of the best round under a patience rule -- rounds stop once
    ``patience`` rounds pass without a new best, the best one is kept."""
    best_i, best = 0, float("inf")
    for i, e in enumerate(errors):
        if e < best:
            best_i, best = i, e
        elif i - best_i >= patience:
            break
    return best_i


def train(features: DataFrame, model_type: str = "xgboost", train_period: Mapping | None = None,
          test_size: float = DEFAULT_TEST_SIZE, hyperparams: Mapping | None = None,
          test_period: Mapping | None = None, nulls: str = "drop",
          early_stopping: int | None = None, model_name: str | None = None,
          now: dt.datetime | None = None, split: str = "time",
          materialize_input: bool = True, outlets: DataFrame | None = None,
          data_range: tuple | None = None, engine: str = "ml") -> TrainResult:
    """M9: filter -> split -> encode (on train+test outlets) -> fit -> evaluate
    -> metadata.  ``split="time"`` cuts at the Date quantile (M2),
    ``split="stratified"`` takes a seeded exact 20 % per outlet (M4, as the
    model-comparison script does); a ``test_period`` gives M3.
    ``test_size=0`` fits on every row (of the period), without a test side.
    ``outlets``: rows whose outlets the encoder also knows (a job that
    forecasts outlets without a training row).  ``data_range``: the range to
    record, if ``features`` are already filtered.  NULL features under
    ``nulls="sentinel"`` get a value below all others; it is recorded and
    scoring uses it again.
    ``early_stopping=k`` applies M8 with patience ``k`` on the test rows and
    refits with the best number of rounds, which the metadata then hold.
    ``engine="histogram"`` fits with the library's own booster: ``nulls`` may
    also be ``keep``, and early stopping cuts the one fit at its best round."""
    if split not in ("time", "stratified"):
        raise ValueError("split must be 'time' or 'stratified'")
    if engine not in ("ml", "histogram"):
        raise ValueError("engine must be 'ml' or 'histogram'")
    if engine == "ml" and nulls == "keep":
        raise ValueError("Spark ML trees reject NULL features: nulls='keep' needs engine='histogram'")
    params, spark_params = gbt_params(model_type, hyperparams)
    base, split_df, bounds, sentinel = _prepare(features, train_period, test_period, test_size, nulls, split,
                                   int(params.get("random_state", params.get("random_seed", DEFAULT_SEED))),
                                   materialize_input)
    split = split_df
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train_df = split.where(F.col(SPLIT) == "train")
        test_df = split.where(F.col(SPLIT) == "test")
        more = [outlets] if outlets is not None else []
        errors, best = [], None
        if engine == "histogram":
            model = profiles.fit_profile(train_df, test_df, model_type, params, early_stopping, more)
            errors, best = model.boosted.held_out_rmse, model.boosted.best_round
            if early_stopping and best is not None:
                params = {k: best + 1 if _NAME_MAP.get(k) == "maxIter" else v for k, v in params.items()}
        else:
            encoder = fit_outlet_encoder(outlet_union(train_df, test_df, *more))
            model = build_pipeline(model_type, encoder, spark_params).fit(train_df)
        if early_stopping and engine == "ml":
            vec = model.transform(test_df) if test_df.limit(1).count() else None
            if vec is not None:
                errors = list(model.stages[-1].evaluateEachIteration(vec, "squared"))
                best = best_iteration(errors, early_stopping)
                if best + 1 < len(errors):
                    spark_params = dict(spark_params, maxIter=best + 1)
                    params = {k: best + 1 if _NAME_MAP.get(k) == "maxIter" else v for k, v in params.items()}
                    model = build_pipeline(model_type, encoder, spark_params).fit(train_df)
        scored = model.transform(test_df)
        m = evaluate(scored).first().asDict()
    finally:
        split.unpersist()
    metrics = {"mae": m["mae"], "rmse": m["rmse"], "r2": m["r2"], "test_size": int(m["test_size"])}
    created = now or dt.datetime.now()
    metadata = {
        "model_name": model_name,
        "model_type": model_type,
        "training_period": dict(train_period) if train_period else None,
        "created_at": created,
        "data_range": dict(zip(("train_start", "train_end"), data_range or bounds)),
        "metrics": metrics,
        "features": list(FEATURES),
        "hyperparameters": {k: str(v) for k, v in params.items()} | (
            {"engine": engine, "null_sentinel": "nan"} if engine == "histogram" else {"null_sentinel": str(sentinel)}),
    }
    return TrainResult(model, model_type, metrics, metadata, params, best, errors, sentinel)


def train_profiles(features: DataFrame, model_types=MODEL_TYPES, **kwargs) -> dict[str, TrainResult]:
    """Train several profiles on one feature table: the table is
    checkpointed once, and the fits run from concurrent driver threads, so
    Spark schedules their (individually small) per-level jobs side by side.
    Returns ``{model_type: TrainResult}``."""
    from concurrent.futures import ThreadPoolExecutor
    base = materialize(features)
    with ThreadPoolExecutor(max_workers=len(model_types)) as pool:
        futures = {m: pool.submit(train, base, m, materialize_input=False, **kwargs) for m in model_types}
        return {m: f.result() for m, f in futures.items()}


def predict(model: PipelineModel | BoostedModel, df: DataFrame, nulls: str = "sentinel", sentinel: float = NULL_SENTINEL) -> DataFrame:
    """Encode Outlet (unseen raises) and score; adds ``prediction``.
    ``sentinel`` is the fill recorded with the model."""
    if isinstance(model, BoostedModel):
        return model.transform(df)
    return model.transform(handle_nulls(df, nulls, sentinel)).drop(VECTOR, OUTLET_NUM)


def forecast_next_day(model: PipelineModel | BoostedModel, rows: DataFrame, sentinel: float = NULL_SENTINEL) -> DataFrame:
    """Score the given rows on the 12 features, no state roll."""
    return predict(model, rows, sentinel=sentinel).select(OUTLET, DATE, PREDICTION)


def feature_importance(spark, result: TrainResult, top_n: int = DEFAULT_TOP_FEATURES,
                       ascending: bool = False) -> DataFrame:
    """M14 + O2: importance per feature (Spark scale: sums to 1), top ``n``."""
    if isinstance(result.model, BoostedModel):
        return profiles.importance_table(spark, result.model, top_n, ascending)
    imp = result.gbt.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(FEATURES, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    order = F.col("importance").asc() if ascending else F.col("importance").desc()
    return df.orderBy(order, F.col("feature")).limit(top_n)


def metrics_frame(spark, result: TrainResult) -> DataFrame:
    """One-row metrics table of a training run."""
    m = result.metrics
    return spark.createDataFrame([(result.model_type, m["mae"], m["rmse"], m["r2"], m["test_size"])],
                                 "model_type string, mae double, rmse double, r2 double, test_size long")
