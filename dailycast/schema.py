"""Column names, types and fixed values of the sales-forecast data model.

Every operator in the package is ``DataFrame -> DataFrame``; the names
below are the contract between them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference pipeline's for equal results.
# ---------------------------------------------------------------------------

OUTLET = "Outlet"
DATE = "Date"
TARGET = "Total Sales Amount"
DISCOUNT = "Total Discount"

# Model feature order (the tree input vector follows this order).
FEATURES = [
    "Outlet",
    "day",
    "weekday",
    "week",
    "month",
    "year",
    "is_weekend",
    "lag_1",
    "lag_7",
    "lag_14",
    "ma_7",
    "ma_14",
]

# Raw transaction columns that the pipeline drops before aggregating.
RAW_DROP_COLUMNS = [
    "SL",
    "Challan No",
    "Customer Name",
    "Customer Code",
    "Outlet.1",
    "mon",
    "Cash Amount",
    "Card Amount",
    "MFS Amount",
    "Credit Amount",
    "Recovered",
    "Net Credit",
]

LAGS = (1, 7, 14)
MOVING_AVERAGES = (7, 14)
LOOKBACK_DAYS = 14          # history window: last_date - 13 .. last_date
MIN_HISTORY_ROWS = 7        # fewer rows in the window -> outlet is skipped
HISTORY_KEEP = 14           # forecast state keeps the last 14 values
WEEKEND_DAYS = (4, 5, 6)    # weekday >= 4 (Mon=0): Fri, Sat, Sun
WEEKEND_DAYS_FRIDAY_ONLY = (4,)  # the one legacy script that uses weekday == 4
DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
DEFAULT_TOP_FEATURES = 10
PREVIEW_ROWS = 100
EARLY_STOPPING_PATIENCE = 50

# Hyper-parameters of the two model profiles, in the reference's own names.
CATBOOST_DEFAULTS = {
    "iterations": 1000,
    "learning_rate": 0.05,
    "depth": 8,
    "loss_function": "RMSE",
    "eval_metric": "RMSE",
    "random_seed": 42,
    "verbose": 0,
}
XGBOOST_DEFAULTS = {
    "n_estimators": 1000,
    "learning_rate": 0.05,
    "max_depth": 8,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "min_child_weight": 1,
    "reg_alpha": 0.5,
    "reg_lambda": 0.5,
    "random_state": 42,
    "verbosity": 0,
}
MODEL_TYPES = ("catboost", "xgboost")

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------

# Amounts are money with cents; sums run in DECIMAL so that they are exact
# and independent of the order in which partitions are merged.
MONEY = T.DecimalType(28, 8)

DAILY_SCHEMA = T.StructType([
    T.StructField(OUTLET, T.StringType(), False),
    T.StructField(DATE, T.TimestampNTZType(), False),
    T.StructField(TARGET, T.DoubleType(), False),
    T.StructField(DISCOUNT, T.DoubleType(), False),
])

CALENDAR_COLUMNS = ["day", "weekday", "week", "month", "year", "is_weekend"]
LAG_COLUMNS = [f"lag_{n}" for n in LAGS]
MA_COLUMNS = [f"ma_{n}" for n in MOVING_AVERAGES]
NUMERIC_FEATURES = [c for c in FEATURES if c != OUTLET]

DAILY_FORECAST_SCHEMA = T.StructType([
    T.StructField(OUTLET, T.StringType(), False),
    T.StructField(DATE, T.TimestampNTZType(), False),
    T.StructField("Predicted Sales", T.DoubleType(), True),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("training_period", T.StructType([
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ])),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("data_range", T.StructType([
        T.StructField("train_start", T.TimestampNTZType()),
        T.StructField("train_end", T.TimestampNTZType()),
    ])),
    T.StructField("metrics", T.StructType([
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("test_size", T.LongType()),
    ])),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("model_path", T.StringType()),
])

REGISTRY_SCHEMA = T.StructType([
    T.StructField("model_key", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("version", T.StringType()),
    T.StructField("training_period", T.StructType([
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ])),
    T.StructField("test_size", T.DoubleType()),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("registered_at", T.TimestampType()),
])
