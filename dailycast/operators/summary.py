"""Summaries over transactions, daily series and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.columns import day_start, money, month_string
from dailycast.schema import DATE, OUTLET, TARGET

PREDICTED = "Predicted Sales"
REPORT_DIGITS = 4   # averages / deviations are reported rounded to 4 digits


def data_summary(tx: DataFrame) -> DataFrame:
    """A2: record count and date range of the raw rows, distinct outlets, and
    avg/min/max/sample-std of the per-day sales totals (over all outlets).

    One pre-aggregation per (Outlet, Date), then one GROUPING SETS aggregate
    over it -- per day, per outlet, and overall in a single pass (Expand +
    one shuffle) -- and a final fold of those rows.  No branch is joined or
    computed twice, and no group is collected."""
    per_key = (tx.groupBy(OUTLET, DATE)
               .agg(F.count(F.lit(1)).alias("n_tx"), F.coalesce(F.sum(money(TARGET)), F.lit(0)).alias("s"))
               .select(OUTLET, DATE, "n_tx", "s",
                       (F.col(OUTLET).isNotNull() & F.col(DATE).isNotNull()).alias("_valid"),
                       F.to_date(DATE).alias("_day")))
    sets = per_key.groupingSets([["_valid", "_day"], ["_valid", OUTLET], []], "_valid", "_day", OUTLET).agg(
        F.grouping_id().alias("_gid"),
        F.sum("s").cast("double").alias("v"),
        F.sum("n_tx").alias("n"),
        F.min(DATE).alias("t0"),
        F.max(DATE).alias("t1"),
    )
    # grouping_id bits follow (_valid, _day, Outlet): per day = 0b001, per outlet = 0b010, all = 0b111
    gid, valid = F.col("_gid"), F.col("_valid")
    day_v = F.when((gid == 1) & valid, F.col("v"))
    return sets.agg(
        F.coalesce(F.sum(F.when(gid == 7, F.col("n"))), F.lit(0)).alias("total_records"),
        F.min(F.when(gid == 7, F.col("t0"))).alias("start"),
        F.max(F.when(gid == 7, F.col("t1"))).alias("end"),
        F.count(F.when((gid == 2) & valid, F.lit(1))).alias("outlets"),
        F.round(F.avg(day_v), REPORT_DIGITS).alias("average_sales"),
        F.min(day_v).alias("min_sales"),
        F.max(day_v).alias("max_sales"),
        F.round(F.stddev_samp(day_v), REPORT_DIGITS).alias("std_dev"),
    )


def outlet_count(daily: DataFrame, approximate: bool = False) -> DataFrame:
    """A3: number of distinct outlets (exact; HyperLogLog when ``approximate``)."""
    agg = F.approx_count_distinct(OUTLET) if approximate else F.count_distinct(OUTLET)
    return daily.agg(agg.alias("outlets"))


def outlet_list(daily: DataFrame) -> DataFrame:
    """A4: sorted distinct outlets (one row each; sort only at the output)."""
    return daily.select(OUTLET).distinct().orderBy(OUTLET)


def data_status(tx: DataFrame) -> DataFrame:
    """A5: date range and record count of the transactions.

    ``last_training`` is always NULL (as in the reference); model names come
    from the registry (``registry.list_models``)."""
    return tx.agg(
        F.min(DATE).alias("start"),
        F.max(DATE).alias("end"),
        F.count(F.lit(1)).alias("total_records"),
        F.lit(None).cast("timestamp_ntz").alias("last_training"),
    )


def _total(col: str, digits: int | None) -> F.Column:
    s = F.sum(col)
    return s if digits is None else F.round(s, digits)


def monthly_forecast(daily_pred: DataFrame, digits: int | None = None) -> DataFrame:
    """Predicted sales per (Outlet, Month yyyy-MM).

    The forecast arrives partitioned by Outlet, which already satisfies this
    grouping: no second shuffle.  ``digits`` rounds the reported totals."""
    return (daily_pred.groupBy(OUTLET, month_string(F.col(DATE)).alias("Month"))
            .agg(_total(PREDICTED, digits).alias("Predicted Monthly Sales")))


def api_monthly_summary(daily_pred: DataFrame, digits: int | None = None) -> DataFrame:
    """The API's month-first summary ``month, outlet, prediction``."""
    return (daily_pred.groupBy(month_string(F.col(DATE)).alias("month"), F.col(OUTLET).alias("outlet"))
            .agg(_total(PREDICTED, digits).alias("prediction")))


def horizon_total(daily_pred: DataFrame, name: str = "Predicted Total Sales",
                  digits: int | None = None) -> DataFrame:
    """Predicted sales per outlet over the whole horizon (legacy scripts
    name the column after the month, e.g. 'Predicted February 2025 Sales')."""
    return daily_pred.groupBy(OUTLET).agg(_total(PREDICTED, digits).alias(name))


def daily_total_forecast(daily_pred: DataFrame, digits: int | None = None) -> DataFrame:
    """Total prediction per day over all outlets (all rows, not a preview)."""
    return (daily_pred.groupBy(day_start(DATE).alias("date"))
            .agg(_total(PREDICTED, digits).alias("total_prediction")))


def outlet_month_series(monthly: DataFrame, months: list[str] | None = None) -> DataFrame:
    """One row per outlet, one column per month (``yyyy-MM``) holding its
    predicted total.  ``months`` are the horizon's months (``ForecastSpec.months``);
    without them Spark runs ``monthly`` once more to find them."""
    return (monthly.groupBy(OUTLET).pivot("Month", months)
            .agg(F.first("Predicted Monthly Sales")))
