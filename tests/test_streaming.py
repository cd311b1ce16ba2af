import datetime as dt

from dailycast.operators import features as feat
from dailycast.session import scratch_path
from dailycast.streaming import daily as sd

SCHEMA = "Outlet string, Date timestamp_ntz, `Total Sales Amount` double"


def test_incremental_daily_sums_equal_batch_and_replay_is_idempotent(spark):
    src = scratch_path(spark, "stream-src")
    day = dt.datetime(2024, 1, 1)
    part1 = [("A", day, 1.25), ("A", day, 2.5), ("B", day, None)]
    part2 = [("A", day, 3.0), ("B", day + dt.timedelta(days=1), 4.0), (None, day, 9.0)]
    for i, rows in enumerate((part1, part2)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}")
    schema = spark.read.parquet(src).schema
    root = scratch_path(spark, "stream-out")
    stream = sd.stream_table_files(spark, src, "*.parquet", schema)
    sd.write_increments(stream, f"{root}/t", f"{root}/cp").awaitTermination()
    got = sorted(tuple(r) for r in sd.read_daily(spark, f"{root}/t").collect())
    batch = spark.createDataFrame(part1 + part2, SCHEMA)
    want = sorted(tuple(r) for r in feat.daily_sales(batch).select(*sd.read_daily(spark, f"{root}/t").columns).collect())
    assert got == want == [("A", day, 6.75, 0.0), ("B", day, 0.0, 0.0), ("B", day + dt.timedelta(days=1), 4.0, 0.0)]
    sd.write_increments(sd.stream_table_files(spark, src, "*.parquet", schema), f"{root}/t",
                        f"{root}/cp").awaitTermination()
    assert sorted(tuple(r) for r in sd.read_daily(spark, f"{root}/t").collect()) == got
