"""Transaction sources: the raw CSV, date parsing, and the column clean-up
that comes right after the scan."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dailycast.schema import DATE, DISCOUNT, OUTLET, RAW_DROP_COLUMNS, TARGET

_TYPED = {
    DATE: T.StringType(),          # parsed by parse_dates (ANSI: bad value raises)
    OUTLET: T.StringType(),
    TARGET: T.DoubleType(),
    DISCOUNT: T.DoubleType(),
}


def _dedupe_like_pandas(names: Sequence[str]) -> list[str]:
    """Second and later copies of a header get ``.1``, ``.2`` ... (as the
    reference's CSV reader names them, e.g. ``Outlet.1``)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def transaction_schema(header: Sequence[str]) -> T.StructType:
    """Explicit schema for a transaction CSV with the given header order.

    Used columns get their types; every other column is read as a string
    (it is dropped right after the scan)."""
    names = _dedupe_like_pandas(header)
    return T.StructType([T.StructField(n, _TYPED.get(n, T.StringType()), True) for n in names])


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV file (reads one line through Spark)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise FileNotFoundError(f"Transaction data not found or empty at {path}")
    return next(csv.reader(io.StringIO(first[0][0])))


def scan_transactions(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """Read a headered transaction CSV with an explicit schema.

    Column order comes from ``header`` or from the file's first line; the
    schema is then applied positionally, and every file's header must equal
    it, so a file with another column order raises.  Only a header with
    duplicated names (kept as ``name.1``) cannot be compared and is trusted.
    A missing path raises (Spark's AnalysisException)."""
    if header is None:
        header = read_header(spark, path)
    schema = transaction_schema(header)
    return (spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", len(set(header)) < len(header))
            .option("mode", "FAILFAST")
            .csv(path))


def parse_dates(df: DataFrame, column: str = DATE, fmt: str | None = None,
                lenient: bool = False) -> DataFrame:
    """String date to ``timestamp_ntz``.

    Strict by default: under ANSI mode a value that does not parse raises.
    ``lenient=True`` turns bad values into NULL (dropped later as null keys)."""
    src = F.col(column)
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(column, src.cast("timestamp_ntz"))
    if lenient:
        parsed = F.try_to_timestamp(src, F.lit(fmt)) if fmt else F.try_to_timestamp(src)
        parsed = parsed.cast("timestamp_ntz")
    else:
        parsed = F.to_timestamp_ntz(src, F.lit(fmt)) if fmt else F.to_timestamp_ntz(src)
    return df.withColumn(column, parsed)


def drop_columns_strict(df: DataFrame, columns: Sequence[str] = RAW_DROP_COLUMNS) -> DataFrame:
    """Drop the given columns; every one must exist (Spark's drop is silent)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{missing} not found in columns")
    return df.drop(*columns)


def drop_columns_if_present(df: DataFrame, columns: Sequence[str] = RAW_DROP_COLUMNS) -> DataFrame:
    """Tolerant variant (the API loader)."""
    return df.drop(*[c for c in columns if c in df.columns])


def load_transactions(spark: SparkSession, path: str, strict: bool = False, fmt: str | None = None,
                      lenient: bool = False) -> DataFrame:
    """Scan + drop + parse: the transaction table every job starts from.

    ``fmt`` is the date format of the text (e.g. ``M/d/yyyy``); see :func:`parse_dates`."""
    raw = scan_transactions(spark, path)
    raw = drop_columns_strict(raw) if strict else drop_columns_if_present(raw)
    if DATE in raw.columns:
        raw = parse_dates(raw, fmt=fmt, lenient=lenient)
    return raw
