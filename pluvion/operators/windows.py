"""Interval-aware rolling accumulation: windows at each observation, and on a regular half-hour timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.operators.qc import SUPPORTED

WINDOWS = (30, 60, 180, 360)
SUMS = ("um", "ud", "fails", "suspects", "intervals", "usables", *(f"c{c}" for c in SUPPORTED))


def intervals(checked: DataFrame) -> DataFrame:
    """One row per station and minute from QC rows: duration, usable mass and minutes, counts; rows of one minute are added up."""
    dur = F.expr("CASE WHEN delta_prev_min > 0 THEN delta_prev_min ELSE 0 END")
    ok = F.col("usable_interval_extremes")
    count = lambda c: F.sum(c.cast("bigint"))
    return checked.groupBy("station_id", "end_min").agg(
        F.max(dur).alias("dur"), F.sum(F.when(ok, F.coalesce("precip_mm_qc", F.lit(0.0))).otherwise(0.0)).alias("um"), F.sum(F.when(ok, dur).otherwise(0)).alias("ud"),
        count(F.expr("qc_precip = 'FAIL' OR qc_precsum = 'FAIL'") & (dur > 0)).alias("fails"), count(F.expr("qc_precip = 'SUSPECT' OR qc_precsum = 'SUSPECT'") & (dur > 0)).alias("suspects"),
        count(dur > 0).alias("intervals"), count(ok & (dur > 0)).alias("usables"), *[count(dur == c).alias(f"c{c}") for c in SUPPORTED],
    )


def time_chunks(df: DataFrame, minute: str, reach_min: int, chunk_min: int = 1440) -> DataFrame:
    """Copies for windows that look back ``reach_min``: each row in its chunk, and in the next one if a window there can
    reach it.  ``__own`` marks the original; a long series becomes many groups, none larger than a chunk and its reach."""
    own, last = F.floor(F.col(minute) / chunk_min), F.floor((F.col(minute) + reach_min) / chunk_min)
    return df.withColumn("__own_chunk", own).withColumn("__chunk", F.explode(F.sequence(own, last))).withColumn("__own", F.col("__chunk") == F.col("__own_chunk")).drop("__own_chunk")


def trailing_windows(iv: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per interval end and window (end - W, end]: accumulation and coverage with the left straddler cut in proportion,
    counts, dominant cadence, completeness.  One shuffle for all windows."""
    rows = time_chunks(iv.withColumn("start_min", F.col("end_min") - F.col("dur")), "end_min", max(windows))
    line = Window.partitionBy("station_id", "__chunk").orderBy("end_min")
    out = rows
    for w in windows:
        x = line.rangeBetween(-(w - 1), 0)
        first = lambda c, x=x: F.first(c).over(x)
        trim = F.when(first("dur") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("end_min") - w - first("start_min")) / first("dur")))).otherwise(0.0)
        total = lambda c, x=x: F.sum(c).over(x)
        out = out.withColumn(f"w{w}", F.struct(
            F.lit(w).cast("bigint").alias("window_min"), (total("um") - first("um") * trim).alias("accum_mm"), (total("ud") - first("ud") * trim).alias("usable_minutes"),
            *[total(c).alias(c) for c in SUMS[2:]],
        ))
    rows = out.filter("__own").select("station_id", "end_min", F.inline(F.array(*[f"w{w}" for w in windows])))
    most = F.greatest(*[F.col(f"c{c}") for c in SUPPORTED])
    cadence = F.coalesce(*[F.when((most > 0) & (F.col(f"c{c}") == most), F.lit(c).cast("bigint")) for c in SUPPORTED])
    rows = rows.withColumn("accum_mm", F.round("accum_mm", 6)).withColumn("coverage_ratio", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("usable_minutes") / F.col("window_min"))), 9))
    return rows.select(
        "station_id", "end_min", "window_min", "accum_mm", "coverage_ratio", F.col("fails").alias("fail_count"), F.col("suspects").alias("suspect_count"),
        F.col("intervals").alias("interval_count"), F.col("usables").alias("usable_count"), F.round("usable_minutes", 6).alias("usable_minutes"), cadence.alias("dominant_cadence_min"),
        F.expr("coverage_ratio >= 0.95 AND fails = 0").alias("complete_strict"), F.expr("coverage_ratio >= 0.8").alias("complete_loose"),
    )


def half_hour_bins(iv: DataFrame) -> DataFrame:
    """(station_id, bin, mass, minutes, fail): interval mass shared out over the half-hours it overlaps, by minutes."""
    rows = iv.filter("dur > 0").withColumn("bin", F.explode(F.expr("sequence((end_min - dur) div 30, (end_min - 1) div 30)")))
    share = F.expr("(least(end_min, bin * 30 + 30) - greatest(end_min - dur, bin * 30)) / dur")
    return rows.groupBy("station_id", "bin").agg(F.sum(F.col("um") * share).alias("mass"), F.sum(F.col("ud") * share).alias("minutes"), F.max((F.col("fails") > 0).cast("int")).alias("fail"))


def reference_windows(bins: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per station, half-hour end and window: accumulation, coverage and strict completeness on the regular timeline."""
    rows = time_chunks(bins.withColumn("ref_end", F.col("bin") * 30 + 30), "ref_end", max(windows))
    line = Window.partitionBy("station_id", "__chunk").orderBy("ref_end")
    for w in windows:
        x = line.rangeBetween(-(w - 30), 0)
        rows = rows.withColumn(f"w{w}", F.struct(F.lit(w).cast("bigint").alias("window_min"), F.round(F.sum("mass").over(x), 6).alias("accum_mm"), F.round(F.least(F.lit(1.0), F.sum("minutes").over(x) / w), 9).alias("coverage_ratio"), F.max("fail").over(x).alias("fail")))
    rows = rows.filter("__own").select("station_id", "ref_end", F.inline(F.array(*[f"w{w}" for w in windows])))
    return rows.select("station_id", "ref_end", "window_min", "accum_mm", "coverage_ratio", F.expr("coverage_ratio >= 0.95 AND fail = 0").alias("strict"))
