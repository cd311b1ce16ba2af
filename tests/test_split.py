import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dailycast.operators import split as sp
from conftest import ts


def _frame(spark, days, outlets=("A",)):
    rows = [(o, ts(f"2024-01-{d:02d}"), float(d)) for o in outlets for d in days]
    return spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")


def test_cutoff_matches_linear_row_quantile(spark):
    days = [1, 2, 2, 3, 7, 9, 9, 9, 15, 20]
    df = _frame(spark, sorted(set(days)))
    df = df.unionByName(_frame(spark, [2, 9, 9]))
    got = sp.cutoff_value(df, 0.2)
    dates = pd.Series(pd.to_datetime([f"2024-01-{d:02d}" for d in sorted(days)]))
    want = dates.quantile(0.8).value / 1000.0   # ns -> us
    assert math.isclose(got, want, rel_tol=0, abs_tol=1.0)
    split = sp.time_split(df, 0.2)
    assert split.where("split = 'train'").agg(F.max("Date")).first()[0] < split.where(
        "split = 'test'").agg(F.min("Date")).first()[0]


def test_stratified_split_exact_quota_and_repeatable(spark):
    df = _frame(spark, range(1, 16), outlets=("A", "B", "C"))
    s1 = sp.stratified_split(df, 0.2, seed=42)
    counts = {r["Outlet"]: r["n"] for r in s1.where("split = 'test'").groupBy("Outlet").agg(F.count("*").alias("n")).collect()}
    assert counts == {"A": 3, "B": 3, "C": 3}           # ceil(15 * 0.2) exactly
    s2 = sp.stratified_split(df, 0.2, seed=42)
    assert sorted(s1.collect()) == sorted(s2.collect())
    s3 = sp.stratified_split(df, 0.2, seed=7)
    assert sorted(s1.where("split='test'").collect()) != sorted(s3.where("split='test'").collect())


def test_named_periods(spark):
    rows = [("A", ts(d), 1.0) for d in ("2024-11-15", "2024-12-01", "2025-01-10", "2025-01-31", "2024-01-31")]
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    assert sp.resolve_named_period(df, None).count() == 5
    assert sp.resolve_named_period(df, "full").count() == 5
    assert sp.resolve_named_period(df, "jan_2025").count() == 2
    assert sp.resolve_named_period(df, "3months").count() == 4     # >= 2024-10-31
    with pytest.raises(ValueError):
        sp.resolve_named_period(df, "fortnight")


def test_period_split_uses_same_input(spark):
    rows = [("A", ts(d), 1.0) for d in ("2024-11-15", "2024-12-01", "2025-01-10")]
    df = spark.createDataFrame(rows, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    s = sp.period_split(df, {"year": 2024}, {"year": 2025, "month": 1})
    assert {(r["split"], r["n"]) for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        ("train", 2), ("test", 1)}


def test_encoder_sorted_codes_and_unseen_raises(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "Outlet string")
    enc = sp.fit_outlet_encoder(df)
    assert enc.labels == ["a", "b", "c"]
    codes = {r["Outlet"]: r["Outlet_code"] for r in enc.transform(df).collect()}
    assert codes == {"a": 0.0, "b": 1.0, "c": 2.0}
    with pytest.raises(Exception):
        sp.label_lookup(spark.createDataFrame([("zzz",)], "Outlet string"), enc).collect()


def test_stratified_bucket_layout_equals_window_layout(spark):
    df = _frame(spark, range(1, 31), outlets=("A", "B", "C", "D"))
    a = sp.stratified_split(df, 0.2, seed=42)
    b = sp.stratified_split(df, 0.2, seed=42, layout="buckets")
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


def test_encoder_size_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "Outlet string")
    with pytest.raises(ValueError):
        sp.fit_outlet_encoder(df, max_labels=2)


def test_splits_partition_all_rows(spark):
    df = _frame(spark, range(1, 29), outlets=("A", "B", "C"))
    for s in (sp.time_split(df), sp.stratified_split(df), sp.stratified_split(df, layout="buckets")):
        sides = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert sides["train"] + sides["test"] == df.count()
        assert s.select("Outlet", "Date").distinct().count() == df.count()
