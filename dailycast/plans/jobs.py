"""Batch jobs that replace the reference's web endpoints.

Each job is a plain function over a transaction DataFrame and a store root
on the shared file system; results are DataFrames (and small dicts)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.operators.features import daily_sales, prepare_features
from dailycast.operators.forecast import ForecastSpec
from dailycast.operators.select import api_daily, api_predictions, filter_date_range, filter_outlet, preview
from dailycast.operators.split import period_of_name, resolve_named_period
from dailycast.operators.summary import api_monthly_summary
from dailycast.plans.profiles import BoostedModel
from dailycast.plans.train import NULL_SENTINEL, train
from dailycast.plans.tree_forecast import TreeEnsemble, forecast_with_trees
from dailycast.schema import DATE, DEFAULT_TEST_SIZE, MODEL_TYPES, PREVIEW_ROWS
from dailycast.session import materialize
from dailycast.sources import modelstore as ms

PREDICTION_SCHEMA = "outlet string, date timestamp_ntz, prediction double"


def training_job(spark: SparkSession, tx: DataFrame, root: str, model_type: str = "xgboost",
                 training_period: str | None = None, hyperparams: dict | None = None,
                 now: dt.datetime | None = None, nulls: str = "sentinel",
                 test_size: float = DEFAULT_TEST_SIZE, engine: str = "ml") -> dict:
    """Features (no NULL-row drop, API path) -> named period (M20) ->
    train -> save model + metadata -> register.  The model is named
    ``{type}_{period or full}_{yyyymmdd_HHMMSS}``.

    Rows with NULL lags are kept, so outlets with a short history train too,
    and the encoder knows every outlet of the input.  Metadata and registry
    hold the period (year and month of a name like ``jan_2025``; any name also
    as the hyper-parameter ``training_period``) and the whole input's range.
    ``engine="histogram"`` fits the library's own booster, with ``nulls="keep"``."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}; known: {', '.join(MODEL_TYPES)}")
    now = now or dt.datetime.now()
    period = training_period or "full"
    everything = materialize(prepare_features(tx, drop_nans=False))
    whole = everything.agg(F.min(DATE).alias("a"), F.max(DATE).alias("b")).first()
    named = period_of_name(training_period)
    feats = everything if named else resolve_named_period(everything, training_period, materialize_input=False)
    result = train(feats, model_type, train_period=named, hyperparams=hyperparams, nulls=nulls, now=now, test_size=test_size,
                   materialize_input=False, outlets=everything, data_range=tuple(whole), engine=engine)
    result.metadata["hyperparameters"]["training_period"] = period
    name = f"{model_type}_{period}_{now:%Y%m%d_%H%M%S}"
    ms.save_model(spark, result.model, result.metadata, root, name)
    ms.register(spark, root, [{"model_type": model_type, "model_name": name[len(model_type) + 1:], "training_period": named,
                               "test_size": test_size, "hyperparameters": result.metadata["hyperparameters"]}], now=now)
    return {"status": "success", "model_name": name, "model_type": model_type,
            "metrics": result.metrics, "training_period": period, "timestamp": now.isoformat()}


@dataclass
class ForecastOutput:
    model_name: str
    path: str
    daily: DataFrame          # outlet, date, prediction (read back from the written file)
    monthly: DataFrame        # month, outlet, prediction
    predictions_count: int
    start: str
    end: str
    monthly_path: str | None = None

    def preview(self, n: int = PREVIEW_ROWS) -> DataFrame:
        """O3: the first ``n`` daily predictions in (outlet, date) order."""
        return preview(self.daily, n, order=("outlet", "date"))


def forecast_job(spark: SparkSession, tx: DataFrame, root: str, model_name: str, outlet: str | None = None,
                 start: str | None = None, end: str | None = None,
                 now: dt.datetime | None = None, write_monthly: bool = False) -> ForecastOutput:
    """Load model (FileNotFoundError when missing) -> features (no drop)
    -> [outlet filter first] -> recursive tree forecast -> write CSV (S3) ->
    monthly summary (A7) from the written file; ``write_monthly`` also
    writes the monthly totals as CSV (S4, as the forecast scripts do).

    Writing the forecast to the shared folder and reading it back cuts the
    lineage: counting, previewing and summarising do not recompute it, and
    a lost executor only re-reads files."""
    now = now or dt.datetime.now()
    start = start or now.strftime("%Y-%m-%d")
    end = end or (now + dt.timedelta(days=30)).strftime("%Y-%m-%d")
    model, meta = ms.load_model(spark, root, model_name)
    ens = None
    if not isinstance(model, BoostedModel):
        gbt = model.stages[-1]
        ens = TreeEnsemble.from_gbt(spark, gbt, path=f"{meta['model_path']}/stages/*_{gbt.uid}")
    feats = prepare_features(tx, drop_nans=False)
    fill = float(meta["hyperparameters"].get("null_sentinel", NULL_SENTINEL))
    daily = forecast_with_trees(feats, model, ForecastSpec(start=start, end=end, outlet=outlet), ens, fill)
    path = f"{root}/predictions/{ms.prediction_file_name(model_name, start, end)}"
    ms.write_table(api_predictions(daily), path, "csv")
    written = spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(path)
    monthly = api_monthly_summary(written.select(F.col("outlet").alias("Outlet"), F.col("date").alias("Date"),
                                                 F.col("prediction").alias("Predicted Sales")))
    monthly_path = None
    if write_monthly:
        monthly_path = path[: -len(".csv")] + "_monthly.csv"
        ms.write_table(monthly, monthly_path, "csv")
    return ForecastOutput(model_name, path, written, monthly, written.count(), start, end, monthly_path)


def daily_data_query(tx: DataFrame, outlet: str | None = None, start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """Daily sums -> [outlet] -> API projection -> [inclusive date range]."""
    d = filter_outlet(daily_sales(tx), outlet)
    return filter_date_range(api_daily(d), start, end, date_col="date")


def training_status(spark: SparkSession, tx: DataFrame, root: str) -> dict:
    """A5: model keys from the registry plus the data range and row count."""
    from dailycast.operators.summary import data_status
    keys = [r[0] for r in ms.list_models(ms.read_registry(spark, root)).collect()]
    st = data_status(tx).first()
    return {"models": keys, "last_training": None,
            "data_range": {"start": st["start"], "end": st["end"], "total_records": st["total_records"]}}
