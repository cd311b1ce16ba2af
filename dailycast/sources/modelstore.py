"""Model store, run metadata, registry and output files.

Everything lives under one root folder on the shared file system:

    <root>/models/<name>/      PipelineModel (Spark ML format)
    <root>/metadata/           run log: one row per saved model (parquet, append)
    <root>/registry/           registry rows (parquet, append; latest wins)
    <root>/predictions/<file>  forecast outputs (CSV with header)

Tables are appended, never rewritten in place, so concurrent writers only
add files; reads resolve "latest per key" with a window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailycast.schema import METADATA_SCHEMA, MODEL_TYPES, REGISTRY_SCHEMA


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


# --- sinks (S3-S5) ----------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Overwrite ``path`` with ``df`` (CSV with header, or parquet)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def prediction_file_name(model_name: str, start: str, end: str) -> str:
    """API output name ``{model}_{start}_to_{end}.csv`` (same name overwrites)."""
    return f"{model_name}_{start}_to_{end}.csv"


def prediction_history(spark: SparkSession, root: str) -> DataFrame:
    """Forecast outputs under ``<root>/predictions`` with size (KB) and
    modification time, newest name first.  Lists files; their content is not read."""
    base = f"{root}/predictions"
    if not _exists(spark, base):
        return spark.createDataFrame([], "filename string, created timestamp, size_kb double")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
             .select(F.col("path").alias("p"), F.col("length").alias("s"), F.col("modificationTime").alias("t")))
    name = F.element_at(F.split("p", "/"), -2)      # an output is a folder of part files, empty ones included
    per_output = files.groupBy(name.alias("filename")).agg(
        F.max("t").alias("created"), (F.sum("s") / 1024.0).alias("size_kb"))
    return per_output.orderBy(F.col("filename").desc())


# --- models and metadata (S6-S8) -------------------------------------------------------

def _metadata_row(meta: Mapping, path: str) -> tuple:
    tp = meta.get("training_period") or None
    dr = meta.get("data_range") or {}
    m = meta.get("metrics") or {}
    return (
        meta["model_name"], meta["model_type"],
        (tp.get("year"), tp.get("month")) if tp else None,
        meta.get("created_at"),
        (dr.get("train_start"), dr.get("train_end")),
        (m.get("mae"), m.get("rmse"), m.get("r2"), m.get("test_size")),
        list(meta.get("features") or []),
        {str(k): str(v) for k, v in (meta.get("hyperparameters") or {}).items()},
        path,
    )


def save_model(spark: SparkSession, model: PipelineModel, metadata: Mapping, root: str,
               model_name: str) -> dict:
    """Write the PipelineModel and append its metadata row.  Returns
    the paths; raises when there is no model."""
    if model is None:
        raise ValueError("there is no fitted model to save")
    path = f"{root}/models/{model_name}"
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:  # a boosted profile writes its own tables
        model.save(spark, path)
    meta = dict(metadata, model_name=model_name)
    row = spark.createDataFrame([_metadata_row(meta, path)], METADATA_SCHEMA)
    row.write.mode("append").parquet(f"{root}/metadata")
    return {"model": path, "metadata": f"{root}/metadata"}


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The run log, latest row per model name."""
    base = f"{root}/metadata"
    if not _exists(spark, base):
        return spark.createDataFrame([], METADATA_SCHEMA)
    meta = spark.read.schema(METADATA_SCHEMA).parquet(base)
    w = Window.partitionBy("model_name").orderBy(F.col("created_at").desc(), F.to_json(F.struct(*meta.columns)).desc())
    return meta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def load_model(spark: SparkSession, root: str, model_name: str) -> tuple[PipelineModel, dict]:
    """Model + metadata by name; FileNotFoundError when absent."""
    rows = read_metadata(spark, root).where(F.col("model_name") == model_name).limit(1).collect()
    if not rows:
        raise FileNotFoundError(f"Model not found: {model_name}")
    meta = rows[0].asDict(recursive=True)
    if meta["model_type"] not in MODEL_TYPES:
        raise ValueError(f"Unknown model type: {meta['model_type']}")
    if (meta["hyperparameters"] or {}).get("engine") == "histogram":
        from dailycast.plans.profiles import BoostedModel

        return BoostedModel.load(spark, meta["model_path"]), meta
    return PipelineModel.load(meta["model_path"]), meta


def model_metrics(spark: SparkSession, root: str, model_name: str) -> DataFrame:
    """One model's metrics and training info from the run log (one row);
    FileNotFoundError when the model has no metadata."""
    row = read_metadata(spark, root).where(F.col("model_name") == model_name)
    if row.limit(1).count() == 0:
        raise FileNotFoundError(f"Metadata not found for model: {model_name}")
    return row.select("model_name", "metrics.*", "model_type", "training_period", "data_range",
                      "created_at", "features")


# --- registry (S9, S10) -----------------------------------------------------------------

def registry_rows(spark: SparkSession, configs: list[Mapping], now: dt.datetime | None = None) -> DataFrame:
    """Registry rows from config dicts (model_type, model_name, version,
    training_period, test_size, hyperparameters)."""
    now = now or dt.datetime.now(dt.timezone.utc)
    rows = []
    for c in configs:
        tp = c.get("training_period")
        rows.append((f"{c['model_type']}_{c['model_name']}", c["model_type"], c["model_name"],
                     c.get("version", "1.0.0"), (tp.get("year"), tp.get("month")) if tp else None,
                     float(c.get("test_size", 0.2)),
                     {str(k): str(v) for k, v in (c.get("hyperparameters") or {}).items()}, now))
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def register(spark: SparkSession, root: str, configs: list[Mapping], now: dt.datetime | None = None) -> None:
    """S9 upsert: append; the latest row per key wins on read."""
    registry_rows(spark, configs, now).write.mode("append").parquet(f"{root}/registry")


def latest_per_key(registry: DataFrame) -> DataFrame:
    """One row per ``model_key``, the most recently registered (equal times: the greatest row, always the same)."""
    w = Window.partitionBy("model_key").orderBy(F.col("registered_at").desc(), F.to_json(F.struct(*registry.columns)).desc())
    return registry.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    base = f"{root}/registry"
    if not _exists(spark, base):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return latest_per_key(spark.read.schema(REGISTRY_SCHEMA).parquet(base))


def registry_get(registry: DataFrame, model_type: str, model_name: str) -> DataFrame:
    """S9 get: zero rows when absent."""
    return registry.where(F.col("model_key") == f"{model_type}_{model_name}")


def registry_by_type(registry: DataFrame, model_type: str) -> DataFrame:
    return registry.where(F.col("model_type") == model_type)


def list_models(registry: DataFrame) -> DataFrame:
    return registry.select("model_key").orderBy("model_key")


def list_models_with_metadata(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """Registry keys left-joined to run metadata; models without
    metadata get ``status = 'unknown'``."""
    meta = metadata.select(F.col("model_name").alias("model_key"), "model_type", "created_at",
                           F.col("metrics.mae").alias("mae"), F.col("metrics.rmse").alias("rmse"),
                           F.col("metrics.r2").alias("r2"), F.col("metrics.test_size").alias("test_size"),
                           F.lit("trained").alias("_status"))
    out = registry.select("model_key").join(meta, "model_key", "left")
    return out.withColumn("status", F.coalesce(F.col("_status"), F.lit("unknown"))).drop("_status")
