import pytest
from pyspark.errors import PySparkException

from dailycast.schema import RAW_DROP_COLUMNS
from dailycast.session import scratch_path
from dailycast.sources import transactions as tr

HEADER = ["SL", "Date", "Challan No", "Customer Name", "Customer Code", "Outlet", "Outlet", "mon",
          "Total Sales Amount", "Total Discount", "Cash Amount", "Card Amount", "MFS Amount",
          "Credit Amount", "Recovered", "Net Credit"]


def _write_csv(spark, lines):
    path = scratch_path(spark, "csv")
    import os
    local = path.replace("file:", "", 1)
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "transaction.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_scan_csv_with_duplicate_header_and_drop(spark):
    path = _write_csv(spark, [",".join(HEADER),
                              "1,2024-01-01,C1,Ann,K1,Shop A,Shop A,Jan,100.5,1.5,0,0,0,0,0,0",
                              "2,2024-01-02,C2,Bob,K2,Shop B,Shop B,Jan,50,0,0,0,0,0,0,0"])
    raw = tr.scan_transactions(spark, path)
    assert "Outlet.1" in raw.columns
    df = tr.load_transactions(spark, path, strict=True)
    assert sorted(df.columns) == sorted(["Date", "Outlet", "Total Sales Amount", "Total Discount"])
    assert dict(df.dtypes)["Date"] == "timestamp_ntz"
    assert {r["Outlet"] for r in df.collect()} == {"Shop A", "Shop B"}


def test_strict_drop_raises_on_missing_column(spark):
    df = spark.createDataFrame([(1, "x")], "SL int, Outlet string")
    with pytest.raises(KeyError):
        tr.drop_columns_strict(df, RAW_DROP_COLUMNS)
    assert tr.drop_columns_if_present(df, RAW_DROP_COLUMNS).columns == ["Outlet"]


def test_parse_dates_strict_and_lenient(spark):
    df = spark.createDataFrame([("2024-01-01",), ("not a date",)], "Date string")
    with pytest.raises(PySparkException):
        tr.parse_dates(df).collect()
    vals = [r[0] for r in tr.parse_dates(df, lenient=True).collect()]
    assert vals[0].year == 2024 and vals[1] is None


def test_missing_file_raises(spark):
    with pytest.raises(Exception):
        tr.scan_transactions(spark, "/nonexistent/transaction.csv")
