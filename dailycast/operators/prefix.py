"""Running sums inside groups of any size, without a task per group.

Rows are range-partitioned by (group, order), so a hot group spreads over many
partitions.  Each partition numbers and sums its own rows; a small table with one
row per (partition, group) carries what lies before them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailycast.operators.joins import shuffled
from dailycast.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: partition numbers stay as they are."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sums_before(df: DataFrame, group: str, order: list[str], values: Mapping[str, Column]) -> DataFrame:
    """``df`` with, for each value, its sum over the rows of the same group that come earlier in ``order``.

    ``values`` maps new columns to expressions (DECIMAL or integer ones give sums
    that do not depend on the partitioning).  NULL groups form one group; the
    first row of a group gets 0.  Rows equal in ``order`` follow each other in an
    order that the values decide."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = {c: f"_v{i}" for i, c in enumerate(values)}
    keyed = df.withColumns({inner[c]: v for c, v in values.items()})
    keys = [group, *order, *inner.values()]
    parts = _written(keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "prefix")
    own = Window.partitionBy("_part", group).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", group).agg(*(F.sum(v).alias(f"_t{v}") for v in inner.values()))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per partition
    offsets = totals.select(F.col("_part").alias("_p"), F.col(group).alias("_g"),
                            *(F.sum(f"_t{v}").over(earlier).alias(f"_b{v}") for v in inner.values()))
    joined = parts.withColumns({c: F.sum(v).over(own) for c, v in inner.items()}).join(
        shuffled(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    zero = F.lit(0)
    out = joined.withColumns({c: F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"_b{v}"), zero) for c, v in inner.items()})
    return out.select(*df.columns, *values)
