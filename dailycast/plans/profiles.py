"""The two model profiles on the library's own booster.

* ``xgboost``: Outlet as its code in sorted order, row and column sampling, L1 and
  L2 penalties, NULL features with a learned side.
* ``catboost``: Outlet as its ordered target statistic (means over earlier rows
  only), one split for each whole level."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.operators import encoding
from dailycast.plans import boosting
from dailycast.schema import DATE, DEFAULT_TOP_FEATURES, FEATURES, NUMERIC_FEATURES, OUTLET, TARGET
from dailycast.session import materialize, scratch_path

PREDICTION = "prediction"
#: Fixed value: the categorical library's own L2 penalty, which the reference leaves as it is.
CATBOOST_L2 = 3.0
_NAMES = {
    "iterations": "rounds", "n_estimators": "rounds", "learning_rate": "learning_rate", "depth": "depth", "max_depth": "depth",
    "random_seed": "seed", "random_state": "seed", "subsample": "subsample", "colsample_bytree": "colsample",
    "min_child_weight": "min_child_weight", "reg_alpha": "reg_alpha", "reg_lambda": "reg_lambda", "l2_leaf_reg": "reg_lambda",
    "max_bin": "bins", "border_count": "bins",
}
_WHOLE = {"rounds", "depth", "seed", "bins"}
_NOT_USED = {"loss_function", "eval_metric", "verbose", "verbosity"}
COLUMNS = [encoding.VALUE if c == OUTLET else c for c in FEATURES]


def boost_params(model_type: str, hyperparams: Mapping, patience: int | None = None) -> boosting.BoostParams:
    """M7: the booster's parameters for a profile's (already overlaid) hyper-parameters."""
    chosen: dict = {"reg_lambda": CATBOOST_L2, "symmetric": True} if model_type == "catboost" else {}
    for k, v in hyperparams.items():
        if k in _NOT_USED:
            continue
        if k not in _NAMES:
            raise ValueError(f"Unknown hyper-parameter: {k}")
        chosen[_NAMES[k]] = int(v) if _NAMES[k] in _WHOLE else float(v)
    if not 2 <= chosen.get("bins", 64) <= 254:
        raise ValueError("bins must be 2 to 254")
    return boosting.BoostParams(**chosen, patience=patience)


@dataclass
class BoostedModel:
    """A fitted profile: the booster and the outlet dictionary it was trained with."""

    model_type: str
    boosted: boosting.Boosted
    outlets: DataFrame
    unseen: float | None

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` with the outlet's number; an unseen outlet raises (``xgboost``) or counts as the prior (``catboost``)."""
        return encoding.attach(df, self.outlets, self.unseen)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        return boosting.with_prediction(self.encode(df), self.boosted.trees, COLUMNS, PREDICTION).drop(encoding.VALUE)

    def save(self, spark: SparkSession, path: str) -> None:
        boosting.save(spark, self.boosted, path, {"model_type": self.model_type, "unseen": self.unseen})
        self.outlets.write.mode("overwrite").parquet(f"{path}/outlets")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        boosted, about = boosting.load(spark, path)
        return cls(about["model_type"], boosted, spark.read.parquet(f"{path}/outlets"), about["unseen"])


def fit_profile(train: DataFrame, held_out: DataFrame, model_type: str, hyperparams: Mapping, patience: int | None = None,
                outlets: list[DataFrame] = ()) -> BoostedModel:
    """Fit a profile on ``train``; ``held_out`` rows give the error of every round and with ``patience`` stop the fit.

    ``outlets``: more rows whose outlets the ``xgboost`` codes cover."""
    params = boost_params(model_type, hyperparams, patience)
    spark = train.sparkSession
    if model_type == "catboost":
        prior = encoding.target_prior(train)
        dictionary, unseen = encoding.outlet_statistics(train, prior), prior
        own = encoding.ordered_statistic(train, prior)
    else:
        dictionary, unseen = encoding.outlet_codes(train, held_out, *outlets), None
    path = scratch_path(spark, "outlets")
    dictionary.write.parquet(path)  # the model keeps its dictionary as files
    dictionary = spark.read.parquet(path)
    if model_type != "catboost":
        own = encoding.attach(train, dictionary, unseen)

    def rows(df: DataFrame, flag: bool) -> DataFrame:
        return df.select(*COLUMNS, F.col(TARGET).alias("target"), F.lit(flag).alias("held_out"), boosting.row_key(F.col(OUTLET), F.col(DATE)).alias("key"))

    both = materialize(rows(own, False).unionByName(rows(encoding.attach(held_out, dictionary, unseen), True)))
    return BoostedModel(model_type, boosting.fit(both, COLUMNS, params), dictionary, unseen)


def importance_table(spark: SparkSession, model: BoostedModel, top_n: int = DEFAULT_TOP_FEATURES, ascending: bool = False) -> DataFrame:
    """M14 + O2: each feature's share of the splits' total gain, the first ``top_n``."""
    df = spark.createDataFrame(list(zip(FEATURES, map(float, model.boosted.importances))), "feature string, importance double")
    order = F.col("importance").asc() if ascending else F.col("importance").desc()
    return df.orderBy(order, F.col("feature")).limit(top_n)


def round_errors(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """M8: held-out RMSE after each round, and which round the ensemble was cut at."""
    b = model.boosted
    rows = [(i + 1, e, i == b.best_round) for i, e in enumerate(b.held_out_rmse)]
    return spark.createDataFrame(rows, "round int, rmse double, best boolean")


__all__ = ["BoostedModel", "boost_params", "fit_profile", "importance_table", "round_errors", "COLUMNS", "NUMERIC_FEATURES", "PREDICTION"]
