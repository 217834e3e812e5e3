"""Bursts of activity over a stream of changes.

A session window closes when nothing follows within the gap, which is how bursts
are told apart in batches; windows whose gap the watermark has passed are emitted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bursts(changes: DataFrame, gap: int, late: str = "1 hour") -> DataFrame:
    """file, start, end, events of a stream with file and ts; changes later than ``late`` are dropped.

    A burst goes on while the next change comes at most ``gap`` seconds later. Events of
    one second count once, as everywhere.
    """
    second = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")))
    once = changes.select("file", second.alias("ts")).withWatermark("ts", late).dropDuplicates(["file", "ts"])
    # Windows merge if one begins at most at the other's end; the end is behind the last change by the gap.
    windows = once.groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), "file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return windows.select("file", F.unix_seconds("first").alias("start"), F.unix_seconds("last").alias("end"), "events")
