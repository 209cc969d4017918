"""Broadcast hints that are given only after a look at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side table (volumes, operations, positions, shells) is broadcast.
MOST_ROWS = 100_000


def hinted(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def bounded(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint for a join on a condition without a key; more than most_rows rows are refused.

    Spark has no way to shuffle such a join, so a large side would become a product of both tables.
    """
    if df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"a side of a join without a key has over {most_rows} rows")
    return F.broadcast(df)
