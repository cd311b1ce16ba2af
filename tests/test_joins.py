from dailycast.operators.joins import checked_broadcast


def _join_plan(spark, small_rows, bound):
    big = spark.range(0, 5000).withColumnRenamed("id", "k")
    small = spark.range(0, small_rows).withColumnRenamed("id", "k")
    return big.join(checked_broadcast(small, bound), "k")._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_within_the_bound(spark):
    assert "BroadcastExchange" in _join_plan(spark, 100, 1000)
    # Beyond the bound no hint is added (static auto-broadcast is off in the session).
    assert "BroadcastExchange" not in _join_plan(spark, 2000, 1000)
