"""Hints for joins whose one side is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers and short strings up to this number are broadcast; beyond it the same join is a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows. df must be cheap to count."""
    return bounded(df, df.limit(rows + 1).count(), rows)


def bounded(df: DataFrame, count: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which has at most ``count`` rows, with a broadcast hint if they are few."""
    return F.broadcast(df) if count <= rows else df
