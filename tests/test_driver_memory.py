"""What passes through the driver stays small whatever the number of outlets, and little more than the trees themselves."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.operators import encoding
from dailycast.operators import split as sp
from dailycast.operators.prefix import sums_before
from dailycast.plans import boosting as bo


def _with(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield spark
    spark.conf.set(name, before)


@pytest.fixture
def guessing(spark):
    """Spark's own setting: sides of joins whose files look small are broadcast."""
    yield from _with(spark, "spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.fixture
def by_row(spark):
    """Spark's own setting: pandas frames come and go row by row."""
    yield from _with(spark, "spark.sql.execution.arrow.pyspark.enabled", "false")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _days(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("Outlet"), F.lit("2024-01-01").cast("timestamp_ntz").alias("Date"),
                                 (F.col("id") % 10).cast("double").alias("Total Sales Amount"))


def test_large_dictionary_is_not_broadcast(guessing, tmp_path, monkeypatch):
    spark, n = guessing, 3000
    spark.range(n).select(F.col("id").cast("string").alias("Outlet"), F.col("id").cast("double").alias(encoding.VALUE)).write.parquet(str(tmp_path / "d"))
    dictionary = spark.read.parquet(str(tmp_path / "d"))
    days = _days(spark, n + 1)
    monkeypatch.setattr(encoding, "BROADCAST_OUTLETS", n - 1, raising=False)
    far = encoding.attach(days, dictionary, -1.0)
    assert "BroadcastExchange" not in _plan(far)
    monkeypatch.setattr(encoding, "BROADCAST_OUTLETS", n)
    near = encoding.attach(days, dictionary, -1.0)
    assert "BroadcastExchange" in _plan(near) and "Generate" not in _plan(near)  # each outlet once
    want = {**{str(i): float(i) for i in range(n)}, str(n): -1.0}
    for joined in (far, near):
        assert joined.columns == [*days.columns, encoding.VALUE]
        assert {r["Outlet"]: r[encoding.VALUE] for r in joined.collect()} == want
    with pytest.raises(Exception, match=f"unseen outlet: {n}"):
        encoding.attach(days, dictionary).collect()


def test_running_sums_and_quotas_are_not_broadcast(guessing):
    days = _days(guessing, 500)
    summed = sums_before(days, "Outlet", ["Date"], {"n": F.lit(1)})
    assert "BroadcastExchange" not in _plan(summed) and summed.where("n = 0").count() == 500
    split = sp.stratified_split(days.unionByName(days.withColumn("Date", F.col("Date") + F.expr("interval 1 day"))), 0.2)
    assert "BroadcastExchange" not in _plan(split)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 200, "train": 800}


def test_saving_and_loading_takes_little_more_than_the_trees(by_row, tmp_path):
    spark = by_row
    rng, sizes = np.random.default_rng(4), np.full(400, 255)
    roots, n = (np.cumsum(sizes) - sizes).astype(np.int64), int(sizes.sum())
    child = [np.repeat(roots, sizes) + rng.integers(0, 255, n) for _ in range(2)]
    trees = bo.Trees(rng.integers(-1, 12, n).astype(np.int32), rng.random(n), rng.random(n) < 0.5, *child, rng.random(n), rng.random(n),
                     rng.random(n), roots, 1.5, 8)
    model = bo.Boosted(trees, bo.BoostParams(rounds=400), ["a"], [0.5], [], None)
    own = sum(getattr(trees, k).nbytes for k in ("feature", "cut", "missing_left", "left", "right", "value", "gain", "cover"))
    tracemalloc.start()
    try:
        bo.save(spark, model, str(tmp_path / "m"))
        again, _ = bo.load(spark, str(tmp_path / "m"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * own + 10e6
    for k in ("feature", "cut", "missing_left", "left", "right", "value", "gain", "cover", "roots"):
        assert getattr(again.trees, k).dtype == getattr(trees, k).dtype and getattr(again.trees, k).tolist() == getattr(trees, k).tolist()
    none = bo.Boosted(trees.first(0), model.params, ["a"], [], [], None)
    bo.save(spark, none, str(tmp_path / "none"))
    assert bo.load(spark, str(tmp_path / "none"))[0].trees.n_trees == 0
