"""Rounds of tasks that keep their rows, against a job per tree level."""

import pytest
from pyspark.sql import functions as F
from test_boosting import FEATURES, PROFILES, frame, rows_of

from dailycast.plans import boosting as bo
from dailycast.plans import lockstep

PARTS = ("feature", "value", "cut", "missing_left", "left", "right", "gain", "cover", "roots")


@pytest.fixture
def small_shares(monkeypatch):
    monkeypatch.setattr(lockstep, "SHARE_ROWS", 90)
    monkeypatch.setattr(lockstep, "JOB_ROUNDS", 3)


@pytest.mark.parametrize("name", PROFILES)
def test_several_tasks_grow_the_trees_of_a_job_per_level(spark, small_shares, name):
    df, p = frame(spark, rows_of(260, 6)), PROFILES[name]
    assert lockstep.tasks_for(spark, 260) == min(3, spark.sparkContext.defaultParallelism)
    a, b = bo.fit(df, FEATURES, p), bo.fit(df, FEATURES, p, task_rows=100, local_rows=0)
    for x in PARTS:
        assert getattr(a.trees, x).tolist() == getattr(b.trees, x).tolist()
    assert a.held_out_rmse == pytest.approx(b.held_out_rmse, rel=1e-12) and a.train_rmse == pytest.approx(b.train_rmse, rel=1e-12)


def test_early_stopping_across_jobs(spark, small_shares):
    df = frame(spark, rows_of(200, 9)).withColumn("target", F.col("target") * 0.05 + F.pmod(F.xxhash64("key"), F.lit(100)))
    p = bo.BoostParams(rounds=25, learning_rate=0.5, depth=4, bins=16, patience=4)
    a, b = bo.fit(df, FEATURES, p), bo.fit(df, FEATURES, p, task_rows=200, local_rows=0)
    assert a.best_round == b.best_round and a.trees.n_trees == b.trees.n_trees < 25
    assert a.held_out_rmse == pytest.approx(b.held_out_rmse, rel=1e-12)


def test_jobs_do_not_grow_with_rounds_or_levels(spark):
    """A table above the bound of one task's nodes took a job per level."""
    n = bo.LOCAL_ROWS + 5_000
    df = spark.range(n).select((F.col("id") % 97).alias("a"), (F.col("id") % 13).alias("b"), F.lit(None).cast("double").alias("c"),
                               (F.col("id") % 7).alias("d"), (F.col("id") % 89 + F.col("id") % 5).cast("double").alias("target"),
                               (F.col("id") % 5 == 0).alias("held_out"), F.col("id").alias("key"))

    def jobs(rounds, depth):
        group = f"lockstep-{rounds}-{depth}"
        spark.sparkContext.setJobGroup(group, group)
        bo.fit(df, FEATURES, bo.BoostParams(rounds=rounds, depth=depth, bins=16))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(9, 5) <= jobs(2, 2) + 2


def test_when_tasks_cannot_hold_the_rows(spark):
    slots = spark.sparkContext.defaultParallelism
    assert lockstep.tasks_for(spark, slots * 10 + 1, held_rows=10) == 0  # a job per level then
    assert lockstep.tasks_for(spark, 0) == 1


def test_rows_are_scored_alike_by_row_and_by_tree(spark):
    import numpy as np
    trees = bo.fit(frame(spark, rows_of(120)), FEATURES, PROFILES["sampled, L1 and L2"]).trees
    X = np.random.default_rng(1).random((bo.TREEWISE_ROWS + 40, 4)) * 12
    X[::7, 2], X[::5, 3], X[3] = np.nan, np.inf, np.nan
    assert trees._by_row(X).tolist() == trees._by_tree(X).tolist()
    assert trees.predict(X).tolist() == np.concatenate([trees.predict(X[:100]), trees.predict(X[100:])]).tolist()
    assert trees.predict(X[:0]).tolist() == []


def test_fits_side_by_side_that_each_take_every_slot(spark, monkeypatch):
    """Both profiles of a comparison are fitted from two threads: neither waits for the other's tasks for ever."""
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(lockstep, "SHARE_ROWS", 10)
    monkeypatch.setattr(lockstep, "JOB_ROUNDS", 2)
    df, profiles = frame(spark, rows_of(260, 3)), [bo.BoostParams(rounds=5, depth=3, bins=8, symmetric=s) for s in (True, False)]
    assert lockstep.tasks_for(spark, 260) == spark.sparkContext.defaultParallelism
    with ThreadPoolExecutor(2) as pool:
        together = [f.result(120) for f in [pool.submit(bo.fit, df, FEATURES, p) for p in profiles]]
    for both, p in zip(together, profiles):
        alone = bo.fit(df, FEATURES, p, task_rows=100, local_rows=0)
        for x in PARTS:
            assert getattr(both.trees, x).tolist() == getattr(alone.trees, x).tolist()
