"""Bins that grow as detector events arrive: the grid of :mod:`gridloom.sources.bins`, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, step: float = 0.2, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Streaming or batch events (volume_id, at, h, k, l, counts) summed per bin and time window.

    The watermark bounds the state: events later than ``late`` behind the newest are left out of the window
    they belong to, and closed windows leave the state.  The sums combine before the shuffle.
    """
    i = lambda a: F.rint(F.col(a) / step).cast("int").alias(f"i{a}")
    return (
        events.withWatermark("at", late)
        .groupBy("volume_id", F.window("at", every).alias("span"), i("h"), i("k"), i("l"))
        .agg(F.sum("counts").alias("intensity"), F.count("*").alias("n"))
    )


def merged(parts: DataFrame) -> DataFrame:
    """Bins over all time from the windows written so far: sums of sums, σ from the counts."""
    return parts.groupBy("volume_id", "ih", "ik", "il").agg(F.sum("intensity").alias("intensity"), F.sqrt(F.sum("n")).alias("sigma"))
