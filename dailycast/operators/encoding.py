"""Outlets as numbers without a label list on the driver.

A dictionary is a DataFrame (Outlet, value): dense codes in sorted order, or a
statistic of the target.  It is attached by a join whose hot outlets are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.operators.joins import shuffled
from dailycast.operators.prefix import sums_before
from dailycast.schema import DATE, MONEY, OUTLET, TARGET

VALUE = "outlet_value"
#: Parts that the rows of one outlet are dealt into for a join with its dictionary row.
SALTS = 16
#: Outlets up to which a dictionary is broadcast: a few MB in the driver and in each executor.
BROADCAST_OUTLETS = 50_000


def outlet_codes(*frames: DataFrame) -> DataFrame:
    """(Outlet, value) with codes 0, 1, 2, ... in sorted order of all frames' outlets.

    The distinct outlets are range-sorted and each range numbers its own ones
    after those of the ranges before it."""
    names = frames[0].select(OUTLET)
    for more in frames[1:]:
        names = names.unionByName(more.select(OUTLET))
    names = names.where(F.col(OUTLET).isNotNull()).distinct().withColumn("_all", F.lit(0))
    coded = sums_before(names, "_all", [OUTLET], {VALUE: F.lit(1)})
    return coded.select(OUTLET, F.col(VALUE).cast("double").alias(VALUE))


def attach(df: DataFrame, dictionary: DataFrame, unseen: float | None = None) -> DataFrame:
    """``df`` with its outlets' value; an outlet that the dictionary lacks gets ``unseen``, or raises.

    A dictionary of at most ``BROADCAST_OUTLETS`` rows (a bounded count) is broadcast.
    For a larger one rows of one outlet are dealt into ``SALTS`` parts by their date,
    so a hot one does not meet in one task; the dictionary is repeated as often and
    shuffled: it never comes to the driver."""
    named = dictionary.select(F.col(OUTLET).alias("_o"), F.col(VALUE))
    if dictionary.limit(BROADCAST_OUTLETS + 1).count() <= BROADCAST_OUTLETS:
        joined = df.join(F.broadcast(named), F.col(OUTLET) == F.col("_o"), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(DATE)), F.lit(SALTS)) if DATE in df.columns else F.lit(0).cast("long")
        wide = named.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = df.withColumn("_salt", salt).join(shuffled(wide), (F.col(OUTLET) == F.col("_o")) & (F.col("_salt") == F.col("_s")), "left")
    missing: Column = F.lit(unseen) if unseen is not None else F.raise_error(
        F.concat(F.lit("unseen outlet: "), F.coalesce(F.col(OUTLET), F.lit("NULL")))).cast("double")
    return joined.withColumn(VALUE, F.coalesce(F.col(VALUE), missing)).drop("_o", "_s", "_salt")


def target_prior(train: DataFrame) -> float:
    """The mean target of the training rows (one number); 0 without rows."""
    row = train.agg(F.sum(F.col(TARGET).cast(MONEY)).cast("double"), F.count(TARGET)).first()
    return row[0] / row[1] if row[1] else 0.0


def _smoothed(total: Column, n: Column, prior: float) -> Column:
    return (total.cast("double") + F.lit(prior)) / (n + 1)


def ordered_statistic(train: DataFrame, prior: float) -> DataFrame:
    """M5: each training row's mean target over the *earlier* rows of its outlet, the prior counting as one row.

    A row never sees its own target, so the encoding does not leak.  The sums are
    running sums over ranges of (Outlet, Date): a hot outlet spreads over tasks."""
    money = F.col(TARGET).cast(MONEY)
    summed = sums_before(train, OUTLET, [DATE], {"_sum": F.coalesce(money, F.lit(0).cast(MONEY)), "_n": F.when(money.isNull(), 0).otherwise(1)})
    return summed.withColumn(VALUE, _smoothed(F.col("_sum"), F.col("_n"), prior)).drop("_sum", "_n")


def outlet_statistics(train: DataFrame, prior: float) -> DataFrame:
    """(Outlet, value): the same mean over all training rows, for rows that come later."""
    money = F.col(TARGET).cast(MONEY)
    per = train.where(F.col(OUTLET).isNotNull()).groupBy(OUTLET).agg(F.coalesce(F.sum(money), F.lit(0).cast(MONEY)).alias("_sum"),
                                                                    F.count(TARGET).alias("_n"))
    return per.select(OUTLET, _smoothed(F.col("_sum"), F.col("_n"), prior).alias(VALUE))
