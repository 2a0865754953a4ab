"""Running flag counts over a stream of flag accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_flags(accesses: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, flag, reads, writes) of a stream (ts, event_id, flag, access): repeated events count once, late ones up to delay."""
    once = accesses.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    counts = once.groupBy(F.window("ts", window), "flag")
    return counts.agg(F.sum((F.col("access") == "read").cast("long")).alias("reads"), F.sum((F.col("access") == "write").cast("long")).alias("writes"))
