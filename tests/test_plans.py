"""Physical-plan properties the design relies on (shuffles, sharing, pushdown)."""

import re

from dailycast.operators import features as feat
from dailycast.operators import forecast as fc
from dailycast.operators import summary as sm
from dailycast.plans import jobs
from dailycast.sources import testdata as td
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning)", plan)


def test_features_one_window_two_shuffles(spark):
    p = _plan(feat.prepare_features(td.events_by_user(spark, SF_SMALL)))
    assert len(_shuffles(p)) == 2
    assert len(re.findall(r"\bWindow \[", p)) == 1          # lags and averages share one window


def test_forecast_state_adds_no_shuffle(spark):
    f = feat.prepare_features(td.events_by_user(spark, SF_SMALL), drop_nans=False)
    st = fc.forecast_state(f, fc.ForecastSpec(start="2024-01-31", end="2024-02-29"))
    assert len(_shuffles(_plan(st))) == len(_shuffles(_plan(f)))
    assert "WindowGroupLimit" in _plan(st)


def test_block_layout_limits_before_shuffle(spark):
    f = feat.prepare_features(td.events_raw_timestamps(spark, SF_SMALL), drop_nans=False, layout="blocks")
    p = _plan(fc.forecast_state(f, fc.ForecastSpec(start="2024-01-31", end="2024-02-29")))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_data_summary_single_grouping_sets_pass(spark):
    p = _plan(sm.data_summary(td.events_by_user(spark, SF_SMALL)))
    assert p.count("Expand") == 1
    assert p.count("FileScan parquet") == 1


def test_filters_reach_the_scans(spark):
    p = _plan(jobs.daily_data_query(td.retail_transactions(spark, SF_SMALL), outlet="NATION_3",
                                    start="1996-01-01", end="1996-12-31"))
    assert "EqualTo(n_name,NATION_3)" in p
    assert "GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p
