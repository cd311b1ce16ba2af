"""Train/test splits, named training periods and outlet encoding
(A10, A12, M1-M4, M20, U1, J1)."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailycast.functions.columns import epoch_micros, from_epoch_micros, ntz_literal
from dailycast.operators.joins import shuffled
from dailycast.operators.prefix import sums_before
from dailycast.operators.ranking import rank_in_group
from dailycast.operators.select import filter_by_period
from dailycast.session import materialize
from dailycast.schema import DATE, DEFAULT_SEED, DEFAULT_TEST_SIZE, OUTLET

SPLIT = "split"
OUTLET_CODE = "Outlet_code"


def _micros(c: str = DATE) -> Column:
    return epoch_micros(c)


def split_cutoff(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE) -> DataFrame:
    """A10: the ``1 - test_size`` quantile of Date over rows, with linear
    interpolation between rows (pandas ``quantile`` semantics).

    Rows are first counted per distinct Date; running counts over ranges of
    dates then find the two dates to interpolate between.  Returns one row with
    ``cutoff_micros`` (double) and ``cutoff`` (timestamp, micro-second)."""
    per_date = df.where(F.col(DATE).isNotNull()).groupBy(DATE).agg(F.count(F.lit(1)).alias("n"))
    q = counted_quantile(per_date, 1.0 - test_size).withColumnRenamed("quantile", "cutoff_micros")
    return q.withColumn("cutoff", from_epoch_micros(F.round("cutoff_micros").cast("long")))


def counted_quantile(per_date: DataFrame, share: float) -> DataFrame:
    """One row ``quantile``: the exact quantile (in microseconds) of dates that occur ``n`` times each.

    A range sort with running counts finds the two dates around the wanted place;
    no task holds more than a range of the dates, and the driver gets their total."""
    placed = sums_before(per_date.select(DATE, "n").withColumn("_all", F.lit(0)), "_all", [DATE], {"before": F.col("n")})
    total = placed.agg(F.sum("n")).first()[0] or 0
    place = (total - 1) * share
    low, high = math.floor(place), math.ceil(place)
    around = placed.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low))
    first = F.max(F.when(F.col("before") <= low, _micros())).cast("double")
    last = F.max(_micros()).cast("double")
    between = F.lit(float(high - place)) * first + F.lit(float(place - low)) * last
    return around.agg(F.when(first == last, first).otherwise(between).alias("quantile"))


def cutoff_value(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE) -> float | None:
    """The cutoff as a driver-side scalar (a single number)."""
    row = split_cutoff(df, test_size).select("cutoff_micros").first()
    return None if row is None else row[0]


def time_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, cutoff: float | None = None,
               materialize_input: bool = True) -> DataFrame:
    """M2: tag rows ``train`` (Date < cutoff) or ``test`` (Date >= cutoff).

    The cutoff is a scalar computed over the input before the split can be
    tagged, i.e. two passes.  With ``materialize_input`` the input is first
    written once as a reliable checkpoint (shared checkpoint folder), so both
    passes read it instead of recomputing its lineage (e.g. the feature
    pipeline over all raw transactions)."""
    if cutoff is None:
        if materialize_input:
            df = materialize(df)
        cutoff = cutoff_value(df, test_size)
    if cutoff is None:
        return df.withColumn(SPLIT, F.lit("train"))
    return df.withColumn(SPLIT, F.when(_micros() < F.lit(cutoff), "train").otherwise("test"))


def period_split(df: DataFrame, train_period: dict | None, test_period: dict) -> DataFrame:
    """M3: train = rows of ``train_period`` (all rows if None), test = rows of
    ``test_period``, both taken from the same input (documented intent)."""
    train = filter_by_period(df, **(train_period or {})).withColumn(SPLIT, F.lit("train"))
    test = filter_by_period(df, **test_period).withColumn(SPLIT, F.lit("test"))
    return train.unionByName(test)


def stratified_split(df: DataFrame, test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     layout: str = "window") -> DataFrame:
    """M4: ``ceil(n * test_size)`` of all n rows go to test (exact decimal
    arithmetic), chosen by a seeded hash of (Outlet, Date).  Each outlet gives
    the whole part of its share; what is left goes to the largest remainders
    (ties by outlet name), and every outlet keeps at least one training row.

    ``layout="window"``: one window per outlet (a stratum of a daily table
    holds one row per date).  ``layout="buckets"``: ranks come from
    per-(Outlet, hash prefix) counts (:func:`rank_in_group`), so even a
    stratum with a third of all rows is split over up to 65,536 tasks."""
    key = F.md5(F.concat_ws("|", F.col(OUTLET), _micros().cast("string"), F.lit(str(seed))))
    frac = F.lit(Decimal(str(test_size)))
    d = df.withColumn("_h", key)
    quotas = _quotas(df.groupBy(OUTLET).agg(F.count(F.lit(1)).alias("_n")), frac)
    if layout == "buckets":
        ranked = rank_in_group(d, OUTLET, ["_h", DATE], F.substring("_h", 1, 4), "_rank")
    elif layout == "window":
        w = Window.partitionBy(OUTLET)
        ranked = d.withColumn("_rank", F.row_number().over(w.orderBy("_h", DATE)))
    else:
        raise ValueError("layout must be 'window' or 'buckets'")
    columns = [c for c in df.columns]
    return (ranked.join(shuffled(quotas), F.col(OUTLET).eqNullSafe(F.col("_outlet")))
            .select(*columns, F.when(F.col("_rank") <= F.col("_quota"), "test").otherwise("train").alias(SPLIT)))


def _quotas(counts: DataFrame, frac: Column) -> DataFrame:
    """Test rows per outlet by largest remainder (one row per outlet).

    The outlets are range-sorted by remainder and numbered range by range."""
    whole = F.floor(F.col("_n") * frac).cast("long")
    free = F.least(whole, F.col("_n") - 1)
    base = materialize(counts.select(F.col(OUTLET).alias("_outlet"), "_n", free.alias("_free"), (whole - F.col("_n") * frac).alias("_rest")))
    left = base.agg((F.ceil(F.sum("_n") * frac).cast("long") - F.sum("_free")).alias("left")).first()["left"] or 0
    may = base.where(F.col("_free") < F.col("_n") - 1).withColumn("_all", F.lit(0))
    more = sums_before(may, "_all", ["_rest", "_outlet"], {"_before": F.lit(1)}).where(F.col("_before") < left)  # largest remainders first
    quota = base.join(shuffled(more.select(F.col("_outlet").alias("_o"), F.lit(1).alias("_one"))), F.col("_outlet").eqNullSafe(F.col("_o")), "left")
    return quota.select("_outlet", (F.col("_free") + F.coalesce("_one", F.lit(0))).alias("_quota"))


def split_report(split_df: DataFrame) -> DataFrame:
    """Rows and Date range of each side of a split."""
    return split_df.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"))


# --- named training periods (M20) --------------------------------------------

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def period_of_name(name: str | None) -> dict | None:
    """The (year, month) of a name such as ``jan_2025``; None for the other names."""
    m = re.fullmatch(r"([a-z]{3})_(\d{4})", (name or "").lower())
    return {"year": int(m.group(2)), "month": _MONTHS.index(m.group(1)) + 1} if m and m.group(1) in _MONTHS else None


def resolve_named_period(df: DataFrame, name: str | None, materialize_input: bool = True) -> DataFrame:
    """``None``/``full`` -> all rows; ``<n>months`` -> the last n months
    before the latest Date; ``mon_yyyy`` (e.g. ``jan_2025``) -> that month.
    ``<n>months`` needs the latest Date first (a scalar); the input is then
    checkpointed once, as in :func:`time_split`."""
    if name is None or name in ("", "full"):
        return df
    m = re.fullmatch(r"(\d+)months?", name)
    if m:
        if materialize_input:
            df = materialize(df)
        latest = df.agg(F.max(DATE)).first()[0]          # one scalar
        if latest is None:
            return df
        bound = ntz_literal(latest) - F.make_ym_interval(F.lit(0), F.lit(int(m.group(1))))
        return df.where(F.col(DATE) >= bound)
    period = period_of_name(name)
    if period:
        return filter_by_period(df, **period)
    raise ValueError(f"Unknown training period: {name!r}")


# --- outlet encoding (M1, U1, J1) ---------------------------------------------

def outlet_union(*frames: DataFrame) -> DataFrame:
    """Distinct outlets over several frames."""
    out = frames[0].select(OUTLET)
    for f in frames[1:]:
        out = out.unionByName(f.select(OUTLET))
    return out.distinct()


# The fitted label map travels to every task that encodes; it grows with the
# number of outlets, so its size is checked right after fitting.
MAX_ENCODED_OUTLETS = 5_000_000


def fit_outlet_encoder(outlets: DataFrame, handle_invalid: str = "error",
                       max_labels: int = MAX_ENCODED_OUTLETS) -> StringIndexerModel:
    """M1: sorted-label codes 0..k-1 (``alphabetAsc``); unseen labels raise.
    Raises when there are more than ``max_labels`` outlets."""
    model = StringIndexer(inputCol=OUTLET, outputCol=OUTLET_CODE, stringOrderType="alphabetAsc",
                          handleInvalid=handle_invalid).fit(outlets)
    if len(model.labels) > max_labels:
        raise ValueError(f"{len(model.labels)} outlets exceed the encoder bound of {max_labels}")
    return model


def encode_outlet(df: DataFrame, fitted_on: Sequence[DataFrame] | None = None) -> DataFrame:
    """M1: add ``Outlet_code``; fitted on the union of ``fitted_on`` (library
    dialect: train + test) or on ``df`` itself."""
    model = fit_outlet_encoder(outlet_union(*(fitted_on or [df])))
    return model.transform(df)


def label_lookup(df: DataFrame, model: StringIndexerModel) -> DataFrame:
    """Apply a fitted encoder to another frame (unseen outlet raises)."""
    return model.transform(df)
