"""Extreme events: thresholds, declustering, summaries, neighbour support, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pot_thresholds(win: DataFrame, q: float = 0.995, mode: str = "loose") -> DataFrame:
    """Per station and window: wet complete windows, their quantile as threshold, and the completeness summary."""
    complete = F.col(f"complete_{mode}")
    wet = complete & (F.col("accum_mm") > 0)
    strict = F.col("complete_strict")
    n = lambda c: F.sum(c.cast("bigint"))
    pick = lambda c, x: F.when(c, F.col(x))
    return win.groupBy("station_id", "window_min").agg(
        F.count("*").alias("n_rows"), n(strict).alias("n_complete_strict"), n(F.col("complete_loose")).alias("n_complete_loose"), n(complete).alias("n_complete_used"), n(wet).alias("n_wet_windows_used"),
        F.round(F.percentile(pick(wet, "accum_mm"), q), 6).alias("threshold_mm"), F.round(F.percentile("coverage_ratio", 0.5), 6).alias("median_coverage_ratio"), F.round(F.percentile("coverage_ratio", 0.95), 6).alias("p95_coverage_ratio"),
        F.round(F.percentile(pick(strict, "accum_mm"), 0.99), 6).alias("p99_accum_mm_strict"), F.max(pick(strict, "accum_mm")).alias("max_accum_mm_strict"),
    )


def decluster_gap() -> Column:
    return F.when(F.col("window_min") <= 60, 360).otherwise(720)


def event_catalog(win: DataFrame, thresholds: DataFrame, mode: str = "loose") -> DataFrame:
    """Declustered peaks over threshold: candidates further apart than the gap start a new cluster; its first maximum is the event."""
    hot = win.join(thresholds.select("station_id", "window_min", "threshold_mm"), ["station_id", "window_min"]).filter(F.col(f"complete_{mode}") & (F.col("accum_mm") > 0) & (F.col("accum_mm") >= F.col("threshold_mm")))
    line = Window.partitionBy("station_id", "window_min").orderBy("end_min")
    gap = F.col("end_min") - F.lag("end_min").over(line)
    hot = hot.withColumn("__new", (gap.isNotNull() & (gap > decluster_gap())).cast("bigint")).withColumn("cluster_id", F.sum("__new").over(line))
    peak = F.max_by(F.struct("end_min", "accum_mm", "coverage_ratio", "fail_count", "suspect_count"), F.struct("accum_mm", -F.col("end_min")))
    g = hot.groupBy("station_id", "window_min", "cluster_id").agg(peak.alias("p"), F.max("threshold_mm").alias("threshold_mm"), F.count("*").alias("cluster_size"), F.min("end_min").alias("cluster_start_min"), F.max("end_min").alias("cluster_end_min"))
    return g.select(
        "station_id", "window_min", "p.end_min", F.col("p.accum_mm").alias("event_accum_mm"), F.round(F.col("p.accum_mm") * 60 / F.col("window_min"), 6).alias("event_rate_mmh"), "threshold_mm", "p.coverage_ratio",
        "p.fail_count", "p.suspect_count", "cluster_id", "cluster_size", "cluster_start_min", "cluster_end_min", (F.col("cluster_end_min") - F.col("cluster_start_min")).alias("cluster_span_min"),
        F.round(F.col("p.accum_mm") / F.col("threshold_mm"), 6).alias("window_rank_ratio"),
    )


def neighbour_support(events: DataFrame, neighbours: DataFrame, iv: DataFrame, bucket: int = 360) -> DataFrame:
    """Per event: candidate neighbours, and those with rain within (window, tolerance) of it.

    An equi-join on neighbour and six-hour bucket; the exact limits follow.  ``neighbours``: (station_id, neighbour_id, distance_km).
    """
    tol = F.when(F.col("window_min") <= 60, 30).otherwise(60)
    ev = events.select("station_id", "window_min", "end_min", (F.col("end_min") - F.col("window_min") - tol).alias("lo"), (F.col("end_min") + tol).alias("hi")).join(neighbours, "station_id", "left")
    asked = ev.filter("neighbour_id IS NOT NULL").withColumn("bucket", F.explode(F.expr(f"sequence(lo div {bucket}, hi div {bucket})")))
    rain = iv.filter("um > 0").select(F.col("station_id").alias("neighbour_id"), F.col("end_min").alias("rain_min"), F.expr(f"end_min div {bucket}").alias("bucket"))
    seen = asked.join(rain, ["neighbour_id", "bucket"]).filter("rain_min BETWEEN lo AND hi").select("station_id", "window_min", "end_min", "neighbour_id").distinct().withColumn("hit", F.lit(1).cast("bigint"))
    keys = ["station_id", "window_min", "end_min"]
    return ev.join(seen, [*keys, "neighbour_id"], "left").groupBy(*keys).agg(
        F.count("neighbour_id").alias("neighbour_candidates"), F.coalesce(F.sum("hit"), F.lit(0)).alias("neighbour_supporting"),
        F.round(F.min(F.when(F.col("hit") == 1, F.col("distance_km"))), 6).alias("nearest_support_km"),
    ).withColumn("neighbour_support", F.col("neighbour_supporting") > 0)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first n rows of each group with their rank: first n of each salted part, then n of those."""
    part = Window.partitionBy(*group, "__salt").orderBy(*order)
    few = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).withColumn("__k", F.row_number().over(part)).filter(F.col("__k") <= n).drop("__k", "__salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= n)


def audit(top: DataFrame, knn: DataFrame, iv: DataFrame) -> DataFrame:
    """Each top event and neighbour: the neighbour's rain over the event's window from intervals that end inside it."""
    ask = top.join(knn, "station_id").select("station_id", "window_min", "end_min", "rank", "neighbour_rank", "neighbour_id", F.round("distance_km", 6).alias("distance_km"), F.explode(F.expr("sequence((end_min - window_min) div 360, end_min div 360)")).alias("bucket"))
    have = iv.filter("dur > 0").select(F.col("station_id").alias("neighbour_id"), F.col("end_min").alias("n_end"), "dur", "um", "ud", F.expr("end_min div 360").alias("bucket"))
    inside = F.expr("n_end > end_min - window_min AND n_end <= end_min")
    part = F.expr("1 - greatest(0D, least(1D, (end_min - window_min - (n_end - dur)) / dur))")
    keys = ["station_id", "window_min", "end_min", "rank", "neighbour_rank", "neighbour_id", "distance_km"]
    return ask.join(have, ["neighbour_id", "bucket"], "left").groupBy(*keys).agg(
        F.round(F.sum(F.when(inside, F.col("um") * part)), 6).alias("neighbour_accum_mm"), F.round(F.coalesce(F.sum(F.when(inside, F.col("ud") * part)), F.lit(0.0)) / F.col("window_min"), 6).alias("neighbour_coverage"),
        F.coalesce(F.sum(F.when(inside, 1)), F.lit(0)).alias("neighbour_intervals"),
    )
