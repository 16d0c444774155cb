"""Streaming queries: the stored tables as file streams, run once over all files, their sink read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pluvion.operators import late, stamps
from pluvion.plans import stamp_sql
from pluvion.session import scratch_folder, table
from pluvion.streaming import late_stream


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A stored table, one file or a folder of files, as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")  # a pattern: a plain path would have to be a folder


def appended_rows(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there; all rows it gave, with the number of their ``batch``.

    Each batch is written to a folder of its own in the shared folder, beside the stream's state, so that a batch that
    is repeated after a failure replaces itself.  The folder is deleted when the application ends.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{folder}/rows")


def latest_rows(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there; the last row it gave for each key."""
    rest = [c for c in stream.columns if c not in keys]
    return appended_rows(stream, mode).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def stream_hourly_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts and sums per event type from a stream over the events (update mode: hours past the watermark leave the state)."""
    rows = stream_of(spark, sf, "events").select(F.col("event_type").alias("station_id"), F.col("ts").cast("timestamp").alias("event_time"), "value")
    totals = late_stream.windowed_totals(rows).select("station_id", F.unix_seconds("w.start").alias("start_s"), "readings", "total")
    last = latest_rows(totals, "update", ["station_id", "start_s"])
    return last.select(F.col("station_id").alias("event_type"), "start_s", "readings", F.round("total", 4).alias("total"))


def stream_corrected_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rainfall per station from a stream of gauge records, corrected by records up to 24 hours late (update mode).

    The state is the counters' entries, one per reading, merged by Spark's own aggregation without Python work; Spark
    drops those whose cut-off the watermark has passed.
    """
    raw = stream_of(spark, sf, "raw_window").select("ingest_order", "station_id", "timestamp_utc", "inserted_ts", "precip_raw_mm")
    counters = late_stream.corrected_counters(stamps.normalise_stamps(raw, table(spark, sf, "station_clocks")))
    totals = late.period_totals(latest_rows(counters, "update", list(late.KEYS)))
    return totals.select("station_id", "period_start_min", "readings", F.round("total", 4).alias("rain_mm"))


def stream_resent_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Readings per station of a stream of gauge records without resent copies (same instant and value, append mode)."""
    raw = stream_of(spark, sf, "raw_window").select("station_id", "timestamp_utc", "inserted_ts", F.col("precip_raw_mm").alias("value"))
    timed = stamps.normalise_stamps(raw, table(spark, sf, "station_clocks"), arrived_too=False).filter("station_id IS NOT NULL AND t_ms IS NOT NULL AND value IS NOT NULL")
    once = late_stream.dedup_stream(timed.select("station_id", F.timestamp_millis("t_ms").alias("event_time"), "value"))
    return appended_rows(once).groupBy("station_id").agg(F.count("*").alias("readings"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_hourly_totals, stream_corrected_hours, stream_resent_removed)}
ORACLES = {
    "stream_resent_removed": f"WITH {stamp_sql.STAMPS}, u AS (SELECT DISTINCT s.station_id, t_ms, precip_raw_mm AS v FROM st_ s JOIN raw_window USING (ingest_order) WHERE s.station_id IS NOT NULL AND t_ms IS NOT NULL AND precip_raw_mm IS NOT NULL) SELECT station_id, count(*) AS readings, round(sum(v), 4) AS total FROM u GROUP BY station_id",
    "stream_corrected_hours": stamp_sql.ORACLES["p2_hourly_rain"],
    "stream_hourly_totals": "SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, count(*) AS readings, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
