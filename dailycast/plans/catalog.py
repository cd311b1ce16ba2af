"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each running on the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.operators import metrics as mt
from dailycast.operators import select as sel
from dailycast.operators import split as sp
from dailycast.operators import summary as sm
from dailycast.sources import testdata as td
from dailycast.sources import transactions as tr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- step 0/1: scan, daily sums, features ------------------------------------

@register("daily_sales")
def q_daily_sales(spark, sf):
    """A1 on the per-user event series."""
    return feat.daily_sales(td.events_by_user(spark, sf))


@register("daily_sales_retail")
def q_daily_sales_retail(spark, sf):
    """A1 on the retail transactions (nation = outlet), with discounts."""
    return feat.daily_sales(td.retail_transactions(spark, sf))


@register("prepare_features")
def q_prepare_features(spark, sf):
    """Daily -> calendar -> lags/averages -> drop NULL rows."""
    return feat.prepare_features(td.events_by_user(spark, sf))


@register("prepare_features_retail_keep_nulls")
def q_prepare_features_retail(spark, sf):
    """W5 without the NULL drop (API path) on the sparse retail series."""
    return feat.prepare_features(td.retail_transactions(spark, sf), drop_nans=False)


# --- step 2: scans, filters, projections, summaries ---------------------------

def _transaction_csv(spark, sf, without=()):
    """Stand-in input: the retail rows in the raw CSV's shape, written as a
    headered CSV to the shared folder; returns its path."""
    from dailycast.session import scratch_path
    path = scratch_path(spark, "transaction-csv")
    td.retail_raw_csv_shape(spark, sf).drop(*without).write.option("header", True).csv(path)
    return path


@register("scan_transactions")
def q_scan_transactions(spark, sf):
    """Scan the CSV (schema from its header), strict drop of the 12
    columns, Date text parsed to timestamp."""
    return tr.load_transactions(spark, _transaction_csv(spark, sf), strict=True)


@register("drop_columns_if_present")
def q_drop_if_present(spark, sf):
    """The API loader's tolerant drop on a CSV that lacks two of the columns."""
    return tr.load_transactions(spark, _transaction_csv(spark, sf, without=("Recovered", "Net Credit")))


@register("daily_sales_day_grain")
def q_daily_day_grain(spark, sf):
    """A1 with grain='day' on exact event timestamps; no discount column (P10)."""
    return feat.daily_sales(td.events_raw_timestamps(spark, sf), grain="day")


@register("daily_sales_exact_grain")
def q_daily_exact_grain(spark, sf):
    """A1 with the reference's exact-timestamp grain on event times."""
    return feat.daily_sales(td.events_raw_timestamps(spark, sf), grain="exact")


@register("date_features")
def q_date_features(spark, sf):
    """F1/F2 on the retail daily series (years 1995-2001, ISO weeks at New Year)."""
    return feat.date_features(feat.daily_sales(td.retail_transactions(spark, sf)))


@register("date_features_friday_weekend")
def q_date_features_friday(spark, sf):
    """F2 legacy rule: weekend = Friday only."""
    from dailycast.schema import WEEKEND_DAYS_FRIDAY_ONLY
    return feat.date_features(feat.daily_sales(td.retail_transactions(spark, sf)), WEEKEND_DAYS_FRIDAY_ONLY)


@register("lag_features_full_window")
def q_lag_full(spark, sf):
    """Legacy averages (NULL until the window is full), then P8."""
    return feat.legacy_features(td.events_by_user(spark, sf))


@register("moving_average_exclude_current")
def q_ma_exclude(spark, sf):
    """W2 variant: averages end one row before the current one (no leak)."""
    d = feat.daily_sales(td.events_by_user(spark, sf))
    return feat.lag_features(d, exclude_current=True)


@register("select_features")
def q_select_features(spark, sf):
    """The 12 features in order plus the target."""
    return sel.select_features(feat.prepare_features(td.events_by_user(spark, sf)))


@register("filter_by_period")
def q_filter_by_period(spark, sf):
    """Year and month (Date range) on the retail feature table."""
    return sel.filter_by_period(feat.prepare_features(td.retail_transactions(spark, sf)), year=1998, month=6)


@register("filter_by_month_any_year")
def q_filter_by_month(spark, sf):
    """Month alone spans all years."""
    return sel.filter_by_period(feat.prepare_features(td.retail_transactions(spark, sf)), month=12)


@register("filter_period_set")
def q_filter_period_set(spark, sf):
    """P5: (1999, Nov-Dec) or (2000, Jan)."""
    f = feat.prepare_features(td.retail_transactions(spark, sf))
    return sel.filter_period_set(f, [(1999, [11, 12]), (2000, [1])])


@register("daily_data_query")
def q_daily_data_query(spark, sf):
    """Daily sums -> outlet filter -> API projection -> date range."""
    d = feat.daily_sales(td.retail_transactions(spark, sf))
    return sel.filter_date_range(sel.api_daily(sel.filter_outlet(d, "NATION_7")),
                                 "1997-01-01", "1998-12-31", date_col="date")


@register("daily_data_date_range")
def q_daily_date_range(spark, sf):
    """All outlets, inclusive day bounds, API projection."""
    d = feat.daily_sales(td.events_raw_timestamps(spark, sf), grain="day")
    return sel.filter_date_range(sel.api_daily(d), "2024-01-10", "2024-01-20", date_col="date")


@register("drop_nulls")
def q_drop_nulls(spark, sf):
    """P8 on the retail features (sparse series: many NULL lags)."""
    return feat.drop_nulls(feat.prepare_features(td.retail_transactions(spark, sf), drop_nans=False))


@register("data_summary")
def q_data_summary(spark, sf):
    """A2 on the retail transactions."""
    return sm.data_summary(td.retail_transactions(spark, sf))


@register("data_summary_events")
def q_data_summary_events(spark, sf):
    """A2 on per-user events."""
    return sm.data_summary(td.events_by_user(spark, sf))


@register("outlet_count")
def q_outlet_count(spark, sf):
    """A3: distinct outlets of the daily table."""
    return sm.outlet_count(feat.daily_sales(td.events_by_user(spark, sf)))


@register("outlet_list")
def q_outlet_list(spark, sf):
    """A4: sorted distinct outlets."""
    return sm.outlet_list(feat.daily_sales(td.retail_transactions(spark, sf)))


@register("data_status")
def q_data_status(spark, sf):
    """A5: date range and record count of the transactions."""
    return sm.data_status(td.retail_transactions(spark, sf))


@register("sort_daily_preview")
def q_preview(spark, sf):
    """O1/O3: first 100 daily rows in (Outlet, Date) order."""
    return sel.preview(feat.daily_sales(td.retail_transactions(spark, sf)), 100)


# --- step 3: splits, periods, encoding, evaluation -------------------------------

def _features_user(spark, sf):
    return feat.prepare_features(td.events_by_user(spark, sf))


def _features_retail(spark, sf):
    return feat.prepare_features(td.retail_transactions(spark, sf))


@register("split_cutoff")
def q_split_cutoff(spark, sf):
    """A10: 0.8 quantile of Date over feature rows (linear interpolation)."""
    return sp.split_cutoff(_features_retail(spark, sf))


@register("time_split_report")
def q_time_split(spark, sf):
    """M2 + A12: rows and date range of train (Date < cutoff) and test."""
    return sp.split_report(sp.time_split(_features_retail(spark, sf)))


@register("period_split_report")
def q_period_split(spark, sf):
    """M3 + A12: train = 1999, test = Jan 2000, from one feature table."""
    return sp.split_report(sp.period_split(_features_retail(spark, sf), {"year": 1999}, {"year": 2000, "month": 1}))


@register("stratified_split")
def q_stratified(spark, sf):
    """M4: per-outlet exact 20 % test quota by seeded hash."""
    return sp.stratified_split(_features_user(spark, sf)).select(
        "Outlet", "Date", "Total Sales Amount", "split")


@register("stratified_split_buckets")
def q_stratified_buckets(spark, sf):
    """M4 with skew-safe ranks (per-(Outlet, hash prefix) counts + offsets)."""
    return sp.stratified_split(_features_user(spark, sf), layout="buckets").select(
        "Outlet", "Date", "Total Sales Amount", "split")


@register("named_period_3months")
def q_named_3m(spark, sf):
    """M20: '3months' = rows on/after max(Date) - 3 months."""
    return sp.resolve_named_period(_features_retail(spark, sf), "3months")


@register("named_period_month")
def q_named_month(spark, sf):
    """M20: 'jun_1998'."""
    return sp.resolve_named_period(_features_retail(spark, sf), "jun_1998")


@register("encode_outlet")
def q_encode(spark, sf):
    """Sorted-label codes fitted on the union of train and test outlets."""
    s = sp.time_split(_features_retail(spark, sf))
    enc = sp.encode_outlet(s, fitted_on=[s.where("split = 'train'"), s.where("split = 'test'")])
    return enc.select("Outlet", "Date", "split", sp.OUTLET_CODE)


@register("label_lookup")
def q_label_lookup(spark, sf):
    """Encoder fitted on the train side, applied to the test side."""
    s = sp.time_split(_features_user(spark, sf))
    model = sp.fit_outlet_encoder(s.where("split = 'train'").select("Outlet").distinct())
    return sp.label_lookup(s.where("split = 'test'"), model).select("Outlet", "Date", sp.OUTLET_CODE)


def _baseline_predictions(spark, sf):
    s = sp.time_split(_features_user(spark, sf)).where("split = 'test'")
    return s.withColumns({"naive": F.col("lag_1"), "seasonal_naive": F.col("lag_7"),
                          "blend": fc.BLEND.column({c: F.col(c) for c in fc.STATE_FEATURES})})


@register("evaluate_baseline")
def q_evaluate(spark, sf):
    """MAE, RMSE, R2, n of the blend baseline on the time-split test rows."""
    return mt.evaluate(_baseline_predictions(spark, sf), prediction="blend", digits=sm.REPORT_DIGITS)


@register("compare_models")
def q_compare(spark, sf):
    """Three baselines on the same test rows; winner by RMSE."""
    return mt.compare_models(_baseline_predictions(spark, sf),
                             {"naive": "naive", "seasonal_naive": "seasonal_naive", "blend": "blend"},
                             digits=sm.REPORT_DIGITS)


@register("error_reduction")
def q_error_reduction(spark, sf):
    """Reduction of the blend baseline against the naive one."""
    cmp = mt.compare_models(_baseline_predictions(spark, sf), {"naive": "naive", "blend": "blend"})
    return mt.error_reduction(cmp, "naive", "blend", digits=sm.REPORT_DIGITS)


@register("actual_vs_predicted")
def q_actual_vs_predicted(spark, sf):
    """Per-outlet actual and predicted totals of the blend baseline."""
    return mt.actual_vs_predicted(_baseline_predictions(spark, sf), prediction="blend", digits=sm.REPORT_DIGITS)


# --- step 4: recursive forecast with deterministic predictors ----------------------

FORECAST_EVENTS = fc.ForecastSpec(start="2024-01-31", end="2024-02-29")
FORECAST_SCRIPT = fc.ForecastSpec(start="2024-02-01", end="2024-02-29", clamp_start=False,
                                  anchor_period={"year": 2024, "month": 1})
FORECAST_RETAIL = fc.ForecastSpec(start="2001-10-20", end="2001-12-31")


def _api_features_user(spark, sf):
    return feat.prepare_features(td.events_by_user(spark, sf), drop_nans=False)


def _forecast_user(spark, sf):
    return fc.predict_daily(_api_features_user(spark, sf), FORECAST_EVENTS, fc.BLEND)


@register("last_row_per_outlet")
def q_last_row(spark, sf):
    """Feature row at each outlet's latest date."""
    return fc.last_row_per_outlet(_features_retail(spark, sf))


@register("recent_lookback")
def q_recent(spark, sf):
    """Rows within last_date-13 .. last_date per outlet."""
    f = _features_retail(spark, sf)
    return fc.recent_history(f, fc.last_row_per_outlet(f))


@register("skipped_outlets")
def q_skipped(spark, sf):
    """Outlets with fewer than 7 rows in their lookback window."""
    f = _features_retail(spark, sf)
    return fc.skipped_outlets(fc.history_state(fc.recent_history(f, fc.last_row_per_outlet(f))))


@register("restrict_to_period_outlets")
def q_period_outlets(spark, sf):
    """Anchor rows taken inside a period keep only that period's outlets."""
    return fc.last_row_per_outlet(_features_retail(spark, sf), {"year": 2001, "month": 10})


@register("date_spine")
def q_date_spine(spark, sf):
    """per forecast outlet, its days pred_start..end (inclusive)."""
    st = fc.forecast_state(_api_features_user(spark, sf), FORECAST_EVENTS)
    from dailycast.functions.columns import day_spine
    return st.select("Outlet", F.explode(day_spine(F.col("pred_start"), F.col("pred_end"))).alias("Date"))


@register("forecast_daily")
def q_forecast_daily(spark, sf):
    """M12 (library dialect) with the blend predictor on per-user series."""
    return _forecast_user(spark, sf)


@register("forecast_daily_script")
def q_forecast_script(spark, sf):
    """M13 (script dialect: legacy features, anchor in Jan 2024, no clamp), weekly predictor."""
    f = feat.legacy_features(td.events_by_user(spark, sf))
    return fc.predict_daily(f, FORECAST_SCRIPT, fc.WEEKLY)


@register("forecast_daily_fulldata")
def q_forecast_fulldata(spark, sf):
    """M13 full-data variant: legacy features, every outlet, anchor = latest
    row overall, start = last date + 1 (no clamp)."""
    f = feat.legacy_features(td.events_by_user(spark, sf))
    spec = fc.ForecastSpec(start="2024-02-01", end="2024-02-29", clamp_start=False)
    return fc.predict_daily(f, spec, fc.WEEKLY)


@register("forecast_event_types")
def q_forecast_event_types(spark, sf):
    """M12 on the event-type series (few long series), weekly predictor."""
    f = feat.prepare_features(td.events_by_type(spark, sf), drop_nans=False)
    return fc.predict_daily(f, FORECAST_EVENTS, fc.WEEKLY)


@register("forecast_daily_retail")
def q_forecast_retail(spark, sf):
    """M12 on the sparse retail series: some outlets skipped, start clamped."""
    return fc.predict_daily(_features_retail(spark, sf), FORECAST_RETAIL, fc.BLEND)


@register("monthly_forecast")
def q_monthly(spark, sf):
    """A6 over M12."""
    return sm.monthly_forecast(_forecast_user(spark, sf), digits=sm.REPORT_DIGITS)


@register("api_monthly_summary")
def q_api_monthly(spark, sf):
    """A7 over M12."""
    return sm.api_monthly_summary(_forecast_user(spark, sf), digits=sm.REPORT_DIGITS)


@register("horizon_total")
def q_horizon_total(spark, sf):
    """A8 over M13 (February totals)."""
    f = feat.legacy_features(td.events_by_user(spark, sf))
    return sm.horizon_total(fc.predict_daily(f, FORECAST_SCRIPT, fc.WEEKLY),
                            "Predicted February 2024 Sales", digits=sm.REPORT_DIGITS)


@register("daily_total_forecast")
def q_daily_total(spark, sf):
    """Total prediction per day over all outlets."""
    return sm.daily_total_forecast(_forecast_user(spark, sf), digits=sm.REPORT_DIGITS)


@register("outlet_month_pivot")
def q_outlet_month(spark, sf):
    """A14 (pivot form): one column per forecast month."""
    return sm.outlet_month_series(sm.monthly_forecast(_forecast_user(spark, sf), digits=sm.REPORT_DIGITS),
                                  FORECAST_EVENTS.months())


@register("stack_forecasts")
def q_stack(spark, sf):
    """Forecasts of two predictors stacked with a model column."""
    f = _api_features_user(spark, sf)
    a = fc.predict_daily(f, FORECAST_EVENTS, fc.BLEND).withColumn("model", F.lit("blend"))
    b = fc.predict_daily(f, FORECAST_EVENTS, fc.WEEKLY).withColumn("model", F.lit("weekly"))
    return a.unionByName(b)


FLAGSHIP = "monthly_forecast"


# --- step 5-7: boosted trees, tree forecasts, model store and jobs (no SQL oracle) ---

_FITS: dict[tuple, object] = {}


def _once(spark, sf, name, fit):
    """Queries that need the same fitted model share one fit per session and table folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITS:
        _FITS[key] = fit()
    return _FITS[key]


def _train(spark, sf, model_type, **kw):
    """A profile with its own 1,000 rounds on the per-user features (deterministic for a fixed seed)."""
    from dailycast.plans import train as trn
    return _once(spark, sf, ("user", model_type, repr(sorted(kw.items()))),
                 lambda: trn.train(_features_user(spark, sf), model_type, engine="histogram", **kw))


@register("train_xgboost_profile")
def q_train_xgb(spark, sf):
    """Xgboost profile (numeric outlet code, subsampling), time split."""
    from dailycast.plans import train as trn
    return trn.metrics_frame(spark, _train(spark, sf, "xgboost"))


@register("train_catboost_profile")
def q_train_cat(spark, sf):
    """Catboost profile (nominal outlet feature), time split."""
    from dailycast.plans import train as trn
    return trn.metrics_frame(spark, _train(spark, sf, "catboost"))


@register("train_period_split")
def q_train_period(spark, sf):
    """M3/M9: train on the retail year 2000, test on Jan 2001."""
    from dailycast.plans import train as trn
    res = trn.train(_features_retail(spark, sf), "xgboost", train_period={"year": 2000},
                    test_period={"year": 2001, "month": 1}, engine="histogram")
    return trn.metrics_frame(spark, res)


@register("hyperparam_override")
def q_override(spark, sf):
    """M7: registry-style names override the defaults (depth 4, lr 0.1); what
    the fitted model has of them, with the number of test rows it scored."""
    res = _train(spark, sf, "xgboost", hyperparams={"xgboost_max_depth": 4, "xgboost_learning_rate": 0.1})
    b = res.model.boosted
    return spark.createDataFrame([(b.trees.n_trees, b.params.depth, b.params.learning_rate, res.metrics["test_size"])],
                                 "n_trees long, depth long, learning_rate double, test_rows long")


@register("early_stopping")
def q_early_stopping(spark, sf):
    """M8: per-round test RMSE of one fit that stops by patience, and the round it was cut at."""
    from dailycast.plans import profiles
    from dailycast.schema import EARLY_STOPPING_PATIENCE
    return profiles.round_errors(spark, _train(spark, sf, "xgboost", early_stopping=EARLY_STOPPING_PATIENCE).model)


@register("feature_importance")
def q_importance(spark, sf):
    """Top-10 importances of the catboost profile."""
    from dailycast.plans import train as trn
    return trn.feature_importance(spark, _train(spark, sf, "catboost"), 10)


@register("predict_test_rows")
def q_predict(spark, sf):
    """Score the time-split test rows; predictions sit next to the rows."""
    from dailycast.plans import train as trn
    res = _train(spark, sf, "xgboost")
    test = sp.time_split(_features_user(spark, sf)).where("split = 'test'")
    return trn.predict(res.model, test).select("Outlet", "Date", "Total Sales Amount", "prediction")


@register("forecast_next_day")
def q_next_day(spark, sf):
    """Score each outlet's last feature row as it is (no state roll)."""
    from dailycast.plans import train as trn
    res = _train(spark, sf, "xgboost")
    return trn.forecast_next_day(res.model, fc.last_row_per_outlet(_api_features_user(spark, sf)))


@register("actual_vs_predicted_gbt")
def q_avp_gbt(spark, sf):
    """A9 with the xgboost profile on the test rows."""
    from dailycast.plans import train as trn
    res = _train(spark, sf, "xgboost")
    test = sp.time_split(_features_user(spark, sf)).where("split = 'test'")
    return mt.actual_vs_predicted(trn.predict(res.model, test))


@register("compare_gbt_profiles")
def q_compare_gbt(spark, sf):
    """M4 + M16 with trees, as the comparison script: January rows, seeded
    stratified 80/20 split, both profiles trained on it (concurrently) and
    compared on its test side (winner by RMSE)."""
    from dailycast.plans import train as trn
    jan = {"year": 2024, "month": 1}
    fits = trn.train_profiles(_features_user(spark, sf), train_period=jan, split="stratified", engine="histogram")
    cat, xgb = fits["catboost"], fits["xgboost"]
    test = sp.stratified_split(sel.filter_by_period(_features_user(spark, sf), **jan)).where("split = 'test'")
    a = trn.predict(cat.model, test).withColumnRenamed("prediction", "p_catboost")
    b = trn.predict(xgb.model, a).withColumnRenamed("prediction", "p_xgboost")
    return mt.compare_models(b, {"catboost": "p_catboost", "xgboost": "p_xgboost"})


@register("forecast_gbt")
def q_forecast_gbt(spark, sf):
    """M12 scored by the trained xgboost profile (tree ensemble in mapInPandas)."""
    from dailycast.plans import tree_forecast as tf
    res = _train(spark, sf, "xgboost")
    return tf.forecast_with_trees(_api_features_user(spark, sf), res.model, FORECAST_EVENTS)


@register("forecast_gbt_script")
def q_forecast_gbt_script(spark, sf):
    """M13 scored by the catboost profile trained on all January rows (legacy features)."""
    from dailycast.plans import train as trn
    from dailycast.plans import tree_forecast as tf
    f = feat.legacy_features(td.events_by_user(spark, sf))
    res = trn.train(f, "catboost", train_period={"year": 2024, "month": 1}, test_size=0.0, engine="histogram")
    return sm.horizon_total(tf.forecast_with_trees(f, res.model, FORECAST_SCRIPT), "Predicted February 2024 Sales")


def _store(spark, name):
    from dailycast.session import scratch_path
    return scratch_path(spark, name)


def _trained_store(spark, sf):
    """A store with both profiles trained by jobs on the per-user events."""
    import datetime as dt

    from dailycast.plans import jobs

    def fit():
        root = _store(spark, "store")
        for i, mtype in enumerate(["xgboost", "catboost"]):
            jobs.training_job(spark, td.events_by_user(spark, sf), root, mtype, now=dt.datetime(2024, 2, 1, 12, 0, i), nulls="keep",
                              engine="histogram")
        return root
    return _once(spark, sf, "store", fit)


@register("training_job")
def q_training_job(spark, sf):
    """M19 + S6/S8/S9/S10: train, save, register, list models with metadata."""
    from dailycast.sources import modelstore as ms
    root = _trained_store(spark, sf)
    extra = ms.registry_rows(spark, [{"model_type": "xgboost", "model_name": "never_trained"}])
    return ms.list_models_with_metadata(ms.latest_per_key(ms.read_registry(spark, root).unionByName(extra)), ms.read_metadata(spark, root))


@register("forecast_job")
def q_forecast_job(spark, sf):
    """M21 + S3/S4/S7/A7: load a saved model by name, forecast, write the daily
    and monthly CSVs; returns the monthly totals read back."""
    from dailycast.plans import jobs
    root = _trained_store(spark, sf)
    out = jobs.forecast_job(spark, td.events_by_user(spark, sf), root, "xgboost_full_20240201_120000", start="2024-01-31", end="2024-02-29",
                            write_monthly=True)
    return spark.read.option("header", True).schema("month string, outlet string, prediction double") \
        .csv(out.monthly_path)


@register("training_job_rows")
def q_training_job_rows(spark, sf):
    """What a job over January records: period, test rows (rows
    with NULL lags count), and the range of the whole input."""
    import datetime as dt

    from dailycast.plans import jobs
    from dailycast.sources import modelstore as ms
    root = _store(spark, "store")
    info = jobs.training_job(spark, td.events_by_user(spark, sf), root, "xgboost", "jan_2024", now=dt.datetime(2024, 2, 1),
                             nulls="keep", engine="histogram")
    return ms.model_metrics(spark, root, info["model_name"]).select(
        "model_name", F.col("training_period.year").alias("year"), F.col("training_period.month").alias("month"),
        "test_size", F.col("data_range.train_start").alias("train_start"), F.col("data_range.train_end").alias("train_end"))


@register("forecast_job_keys")
def q_forecast_job_keys(spark, sf):
    """Outlets and months of a job's written forecast over the default
    range (30 days from ``now``); outlets with NULL lags are there too."""
    import datetime as dt

    from dailycast.plans import jobs
    out = jobs.forecast_job(spark, td.events_by_user(spark, sf), _trained_store(spark, sf), "xgboost_full_20240201_120000",
                            now=dt.datetime(2024, 1, 31))
    return out.daily.groupBy("outlet", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("prediction").isNull()).alias("n_null"))


@register("ordered_target_statistic")
def q_ordered_statistic(spark, sf):
    """M5: each row's mean target over the earlier rows of its outlet, the overall mean counting as one row."""
    from dailycast.operators import encoding
    f = _features_retail(spark, sf).select("Outlet", "Date", "Total Sales Amount")
    rows = encoding.ordered_statistic(f, encoding.target_prior(f))
    return rows.select("Outlet", "Date", F.round(encoding.VALUE, sm.REPORT_DIGITS).alias("statistic"))


@register("outlet_dictionary")
def q_outlet_dictionary(spark, sf):
    """Dense codes of all outlets by a range sort, attached to every row by a salted join."""
    from dailycast.operators import encoding
    f = _features_user(spark, sf).select("Outlet", "Date")
    return encoding.attach(f, encoding.outlet_codes(f)).select("Outlet", "Date", F.col(encoding.VALUE).cast("int").alias("code"))


@register("predict_test_keys")
def q_predict_keys(spark, sf):
    """Every test row gets a prediction: keys, and whether it is NULL."""
    return q_predict(spark, sf).select("Outlet", "Date", F.col("prediction").isNull().alias("is_null"))


@register("feature_importance_total")
def q_importance_total(spark, sf):
    """The importances of all 12 features sum to 1."""
    from dailycast.plans import train as trn
    imp = trn.feature_importance(spark, _train(spark, sf, "xgboost"), 100)
    return imp.agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


@register("daily_sales_fractional")
def q_daily_fractional(spark, sf):
    """A1 on amounts with six decimals (charges with tax, not rounded)."""
    return feat.daily_sales(td.charges(spark, sf))


@register("prediction_history")
def q_history(spark, sf):
    """Forecast files written under a store, newest name first."""
    from dailycast.sources import modelstore as ms
    root = _store(spark, "store")
    f = _api_features_user(spark, sf)
    for start, end in (("2024-01-31", "2024-02-15"), ("2024-01-31", "2024-02-29")):
        daily = fc.predict_daily(f, fc.ForecastSpec(start=start, end=end), fc.BLEND)
        ms.write_table(sel.api_predictions(daily), f"{root}/predictions/{ms.prediction_file_name('blend', start, end)}")
    return ms.prediction_history(spark, root).select("filename", "size_kb")


# --- streaming -----------------------------------------------------------------------

@register("daily_sales_streaming")
def q_daily_streaming(spark, sf):
    """A1 maintained incrementally: events read as a file stream, partial sums
    per micro-batch written to the shared folder, folded on read."""
    from dailycast.streaming import daily as sd
    root = _store(spark, "stream")
    schema = td.table(spark, sf, "events").schema
    stream = sd.stream_table_files(spark, sf, "events.parquet", schema)
    q = sd.write_increments(stream, f"{root}/daily", f"{root}/checkpoint", prepare=td.event_rows)
    q.awaitTermination()
    return sd.read_daily(spark, f"{root}/daily")


@register("write_outputs")
def q_write_outputs(spark, sf):
    """Daily forecast, monthly totals (from the written daily file)
    and a model comparison written as CSV to the shared folder; returns the
    rows read back from each."""
    from dailycast.plans.jobs import PREDICTION_SCHEMA
    from dailycast.sources import modelstore as ms
    root = _store(spark, "outputs")

    def written(name, df, schema):
        return spark.read.option("header", True).schema(schema).csv(ms.write_table(df, f"{root}/{name}.csv"))

    daily = written("daily", sel.api_predictions(_forecast_user(spark, sf)), PREDICTION_SCHEMA)
    monthly = written("monthly", sm.api_monthly_summary(daily.select(
        F.col("outlet").alias("Outlet"), F.col("date").alias("Date"), F.col("prediction").alias("Predicted Sales"))),
        "month string, outlet string, prediction double")
    compared = mt.compare_models(_baseline_predictions(spark, sf), {"naive": "naive", "blend": "blend"})
    comparison = written("comparison", compared, "Model string, MAE double, RMSE double, r2 double, test_size long, winner string")
    four = lambda c: F.round(c, sm.REPORT_DIGITS).alias("value")
    return (daily.select(F.lit("daily").alias("output"), F.col("outlet").alias("name"),
                         F.date_format("date", "yyyy-MM-dd").alias("period"), four("prediction"))
            .union(monthly.select(F.lit("monthly"), "outlet", "month", four("prediction")))
            .union(comparison.select(F.lit("comparison"), "Model", "winner", four("RMSE"))))


@register("data_range_iso")
def q_data_range_iso(spark, sf):
    """Transaction date range as ISO-8601 text (API format)."""
    from dailycast.functions.columns import iso_string
    st = sm.data_status(td.retail_transactions(spark, sf))
    return st.select(iso_string(F.col("start")).alias("start"), iso_string(F.col("end")).alias("end"),
                     "total_records")


@register("prepare_features_exact_blocks")
def q_features_blocks(spark, sf):
    """W5 at exact-timestamp grain with the skew-safe block layout (series
    rank from per-(Outlet, day) counts, windows per rank block with a halo)."""
    return feat.prepare_features(td.events_raw_timestamps(spark, sf), layout="blocks")


@register("prepare_features_exact_auto")
def q_features_auto(spark, sf):
    """W5 at exact-timestamp grain with layout='auto': the series table is
    checkpointed, its longest series measured, and the layout chosen."""
    return feat.prepare_features(td.events_raw_timestamps(spark, sf), layout="auto")
