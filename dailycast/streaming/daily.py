"""Incremental daily sums with Structured Streaming.

The batch pipeline re-reads all transactions for every request.  Here new
transaction files are read as a stream; every micro-batch reduces its rows
to exact DECIMAL partial sums per (Outlet, Date) and writes them under
``<table>/batch_id=<n>`` (overwritten on retry, so a replayed batch is
idempotent; the query checkpoint records progress).  Readers fold the
partial sums with one more aggregation, which gives the same daily table as
:func:`dailycast.operators.features.daily_sales` over all files so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dailycast.functions.columns import day_start, money
from dailycast.operators.features import drop_null_keys, with_discount
from dailycast.schema import DATE, DISCOUNT, OUTLET, TARGET
from dailycast.sources import modelstore as ms


def partial_daily_sums(tx: DataFrame, grain: str = "exact") -> DataFrame:
    """Exact partial sums of one batch of transactions (DECIMAL, not rounded)."""
    df = with_discount(tx)
    if grain == "day":
        df = df.withColumn(DATE, day_start(DATE))
    return drop_null_keys(df).groupBy(OUTLET, DATE).agg(
        F.sum(money(TARGET)).alias("s_sales"), F.sum(money(DISCOUNT)).alias("s_disc"))


def write_increments(stream_tx: DataFrame, table_path: str, checkpoint_path: str,
                     grain: str = "exact", prepare: Callable[[DataFrame], DataFrame] | None = None,
                     available_now: bool = True) -> StreamingQuery:
    """Start the incremental job: ``stream_tx`` (a streaming DataFrame of
    transactions, optionally mapped by ``prepare``) -> partial sums per
    micro-batch -> ``<table_path>/batch_id=<n>``."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        (partial_daily_sums(rows, grain).write.mode("overwrite")
         .parquet(f"{table_path}/batch_id={batch_id}"))

    writer = (stream_tx.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_daily(spark: SparkSession, table_path: str) -> DataFrame:
    """The daily table so far: fold all partial sums (NULL sums -> 0.0); empty before the first batch."""
    if not ms._exists(spark, table_path):
        return spark.createDataFrame([], f"{OUTLET} string, {DATE} timestamp_ntz, `{TARGET}` double, `{DISCOUNT}` double")
    parts = spark.read.parquet(table_path)
    return parts.groupBy(OUTLET, DATE).agg(
        F.coalesce(F.sum("s_sales").cast("double"), F.lit(0.0)).alias(TARGET),
        F.coalesce(F.sum("s_disc").cast("double"), F.lit(0.0)).alias(DISCOUNT),
    )


def stream_table_files(spark: SparkSession, directory: str, file_glob: str, schema,
                       files_per_trigger: int = 1) -> DataFrame:
    """Streaming read of the parquet files of ``directory`` matching ``file_glob``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(directory))
