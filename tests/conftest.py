import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dailycast.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


TX_SCHEMA = "Outlet string, Date timestamp_ntz, `Total Sales Amount` double, `Total Discount` double"


@pytest.fixture
def tx(spark):
    """Factory: rows (outlet, date-string, amount, discount) -> transactions."""
    def make(rows, with_discount=True):
        if with_discount:
            data = [(o, ts(d) if d else None, a, disc) for o, d, a, disc in rows]
            return spark.createDataFrame(data, TX_SCHEMA)
        data = [(o, ts(d) if d else None, a) for o, d, a in rows]
        return spark.createDataFrame(data, "Outlet string, Date timestamp_ntz, `Total Sales Amount` double")
    return make
