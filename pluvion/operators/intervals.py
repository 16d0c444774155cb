"""Problem 4: overlapping and gapped intervals merged by Spark's session window, gaps by ``lead``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def qc_intervals(df: DataFrame, time: str = "timestamp_utc", length: str = "delta_prev_min") -> DataFrame:
    """(station_id, month, start_min, end_min) of rows (t - length, t]; NULL or non-positive lengths give none."""
    t = F.expr(f"floor(unix_micros(cast({time} AS timestamp)) / 60000000)").cast("bigint")
    month = F.expr(f"year({time}) * 12 + month({time}) - 1").cast("int")
    rows = df.filter(f"station_id IS NOT NULL AND {time} IS NOT NULL AND {length} > 0")
    return rows.select("station_id", month.alias("month"), (t - F.col(length)).alias("start_min"), t.alias("end_min"))


def _sessions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by session windows whose gap is each row's own length."""
    length = F.col("end_min") - F.col("start_min")
    gap = F.make_interval(days=F.floor(length / 1440).cast("int"), mins=(length % 1440).cast("int"))  # days of 24 hours: the session's zone is UTC
    s = rows.groupBy(*keys, F.session_window(F.timestamp_seconds(F.col("start_min") * 60), gap).alias("w")).agg(F.count("*").alias("__n"))
    return s.select(*keys, (F.unix_seconds("w.start") / 60).cast("bigint").alias("start_min"), (F.unix_seconds("w.end") / 60).cast("bigint").alias("end_min"))


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods (keys, start_min, end_min) of intervals that overlap, nest or touch, per key.

    Two rounds: starts of one day are merged first, with equal starts combined to the longest before the shuffle, then
    the days' periods of a key; a key with a third of all rows is spread over its days.  Periods that still touch (the
    session window may keep them apart) are joined afterwards.
    """
    longest = rows.withColumn("__day", F.expr("floor(start_min / 1440)")).groupBy(*keys, "__day", "start_min").agg(F.max("end_min").alias("end_min"))
    periods = _sessions(_sessions(longest, [*keys, "__day"]), keys)
    ordered = Window.partitionBy(*keys).orderBy("start_min", "end_min")
    reach = F.max("end_min").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = periods.withColumn("__new", (reach.isNull() | (F.col("start_min") > reach)).cast("int")).withColumn("__no", F.sum("__new").over(ordered))
    return island.groupBy(*keys, "__no").agg(F.min("start_min").alias("start_min"), F.max("end_min").alias("end_min")).drop("__no")


def covered_and_gaps(intervals: DataFrame, keys: tuple[str, ...] = ("station_id", "month")) -> DataFrame:
    """(keys, kind, start_min, end_min): 'covered' periods and the 'gap's between consecutive ones of a key.

    Rows with a NULL station, time or length, or a length that is not positive, give nothing; repeated rows change
    nothing; an empty table gives no rows.
    """
    merged = merge_intervals(intervals, list(keys))
    following = F.lead("start_min").over(Window.partitionBy(*keys).orderBy("start_min"))
    rows = merged.withColumn("__next", following)
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_min"), F.col(b).alias("end_min"))
    out = rows.select(*keys, F.inline(F.array(piece("covered", "start_min", "end_min"), piece("gap", "end_min", "__next"))))
    return out.filter("end_min IS NOT NULL")
