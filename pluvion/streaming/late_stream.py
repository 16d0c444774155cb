"""Structured Streaming over late gauge records: the conflict-free counters as a keyed table, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.operators import late


def dedup_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop resent copies (same station, event time and value) that come within the watermark."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["station_id", "event_time", "value"])


def windowed_totals(stream: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Totals per station and period by event time; records beyond the watermark are left out by Spark."""
    return stream.withWatermark("event_time", delay).groupBy("station_id", F.window("event_time", window).alias("w")).agg(F.count("*").alias("readings"), F.sum("value").alias("total"))


def corrected_counters(stream: DataFrame, cutoff_min: int = 1440, period_min: int = 60, taken_ms: str = "t_ms") -> DataFrame:
    """The entries of ``late.late_counters`` of a stream, for update mode: (late.KEYS, entry).

    An entry merges by maximum, so that replayed batches change nothing.  The reading's instant is in the key as an event
    time with a watermark of cut-off and period: once no record can correct it any more, Spark drops it from the state.
    """
    timed = stream.withColumn("__at", F.timestamp_millis(F.col(taken_ms))).withWatermark("__at", f"{cutoff_min + period_min} minutes")
    entries = late.entries(timed, (cutoff_min,), period_min=period_min, taken_ms=taken_ms, also=("__at",))
    return entries.groupBy(*late.KEYS, "__at").agg(F.max(F.struct("n", "o", "v")).alias("entry")).drop("__at")
