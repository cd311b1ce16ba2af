"""Join helpers and the lookups of the pipeline that are joins in disguise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The check is a bounded count (``limit(max_rows + 1)``), so it never scans
    more than ``max_rows + 1`` rows.  Beyond the bound the frame is returned
    unchanged and the planner keeps a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` hinted to a sort-merge join, so that no side is broadcast on a guess.

    The planner guesses from file sizes: a few compressed MB may be millions of
    rows, and all of them would pass through the driver."""
    return df.hint("merge")
