"""Problem 2: per-period aggregates by event time, corrected by late records up to a cut-off.

The state is a conflict-free counter: one entry per period, source and version.  A source is one reading (station and
instant); its version is (arrival instant, order of arrival).  Merging keeps the highest version of each source, the
period's value is the sum over its sources, so that retries, reordering and merging in any grouping give the same state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_MS = 60_000
KEYS = ("station_id", "period_start_min", "source_ms", "cutoff_min")


def entries(df: DataFrame, cutoffs_min: Sequence[int], value: str = "precip_raw_mm", taken_ms: str = "t_ms", arrived_ms: str = "n_ms", order: str = "ingest_order", period_min: int = 60, also: Sequence[str] = ()) -> DataFrame:
    """(station_id, period_start_min, source_ms, also, n, o, v, cutoff_min): each record for each cut-off that it arrived by."""
    start = F.expr(f"floor({taken_ms} / {period_min * MINUTE_MS}) * {period_min}").cast("bigint")
    rows = (
        df.select(F.col("station_id"), start.alias("period_start_min"), F.col(taken_ms).alias("source_ms"), *also, F.col(arrived_ms).alias("n"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
        .filter("station_id IS NOT NULL AND source_ms IS NOT NULL AND n IS NOT NULL AND o IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    )
    lateness = F.col("n") - (F.col("period_start_min") + period_min) * MINUTE_MS
    reached = F.filter(F.array(*[F.lit(int(c)) for c in cutoffs_min]), lambda c: lateness <= c * MINUTE_MS)
    return rows.withColumn("cutoff_min", F.explode(reached))


def late_counters(df: DataFrame, value: str = "precip_raw_mm", taken_ms: str = "t_ms", arrived_ms: str = "n_ms", order: str = "ingest_order", period_min: int = 60, cutoffs_min: Sequence[int] = (10, 1440)) -> DataFrame:
    """Counter entries of a batch: (station_id, period_start_min, source_ms, cutoff_min, version, value).

    A record enters the state of each cut-off (minutes after the period's end, inclusive) that it arrived by.  Rows with
    a NULL station, instant, order or value, or a NaN value, take no part.  Of equal versions the larger value stays.
    Rows are combined before the shuffle, and the key holds the reading, so that a station with a third of all rows is
    spread like any other.
    """
    rows = entries(df, cutoffs_min, value, taken_ms, arrived_ms, order, period_min)
    return rows.groupBy(*KEYS).agg(F.max(F.struct("n", "o", "v")).alias("entry"))


def merge_counters(*states: DataFrame) -> DataFrame:
    """Merge states (or batches) by the highest version per source: commutative, associative, idempotent."""
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    return merged.groupBy(*KEYS).agg(F.max("entry").alias("entry"))


def period_totals(state: DataFrame) -> DataFrame:
    """Sum the sources of each period: (station_id, period_start_min, cutoff_min, readings, total)."""
    return state.groupBy("station_id", "period_start_min", "cutoff_min").agg(F.count("*").alias("readings"), F.sum("entry.v").alias("total"))


def corrected_periods(state: DataFrame, early_min: int = 10, final_min: int = 1440, tolerance: float = 0.05) -> DataFrame:
    """Periods whose readings or total differ between two cut-offs; a period without records counts 0 and 0."""
    at = lambda c, f: F.sum(F.when(F.col("cutoff_min") == c, f).otherwise(0))
    one: Column = F.lit(1)
    both = state.groupBy("station_id", "period_start_min").agg(
        at(early_min, one).alias("readings_early"), at(final_min, one).alias("readings_final"),
        F.coalesce(at(early_min, F.col("entry.v")), F.lit(0.0)).alias("total_early"), F.coalesce(at(final_min, F.col("entry.v")), F.lit(0.0)).alias("total_final"),
    )
    differ = (F.col("readings_early") != F.col("readings_final")) | (F.round(F.abs(F.col("total_early") - F.col("total_final")), 6) > tolerance)
    return both.filter(differ)
