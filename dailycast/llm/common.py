"""Helpers shared by the training-data operators: staged tables and ordered prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailycast.session import scratch_path, ship_package

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read, and several
    consumers see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    ship_package(spark)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL (JVM only)."""
    parts = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    empty = ~F.coalesce(text, F.lit("")).rlike(WORD)
    return F.when(empty, F.lit(0)).otherwise(F.size(parts)).cast("long")


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """``df`` in the total order ``order`` with, for each value, the sum over all earlier rows.

    ``values`` maps a new column to a non-negative long expression.  The rows are
    range-partitioned by ``order`` (one hot group spreads over many partitions)
    and written with their partition number; each partition then sums its own
    rows, and a table with one row per partition carries the partitions' offsets.
    Rows equal in the whole of ``order`` follow each other in any order.
    Added columns: the names in ``values``."""
    n = shuffle_partitions(df.sparkSession)
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for k, c in zip(keys, order)),
                      *(c.cast("long").alias(f"_v_{v}") for v, c in values.items()))
    parts = staged(keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)
    offsets = parts.groupBy("_part").agg(*(F.sum(f"_v_{v}").alias(f"_t_{v}") for v in values))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}")
                                        for v in values))
    own = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({v: F.coalesce(F.sum(f"_v_{v}").over(own), F.lit(0)) for v in values})
    # one row per shuffle partition: bounded by a setting, not by the data
    out = summed.join(F.broadcast(offsets), "_part")
    out = out.withColumns({v: F.col(v) + F.col(f"_b_{v}") for v in values})
    drop = ["_part", *keys, *(f"_v_{v}" for v in values), *(f"_b_{v}" for v in values)]
    return out.drop(*drop)
