"""Queries of the general problems (p1 to p6) over the gauge network's tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.operators import intervals, late, near, regular, spikes, stamps
from pluvion.plans import stamp_sql
from pluvion.session import spread, table


def records(spark: SparkSession, sf: str, *columns: str, arrived_too: bool = True) -> DataFrame:
    """raw_window's columns with both stamps as instants (t_ms, n_ms), or only the first."""
    raw = table(spark, sf, "raw_window").select("ingest_order", "station_id", "timestamp_utc", "inserted_ts", *columns)
    return stamps.normalise_stamps(spread(raw), table(spark, sf, "station_clocks"), arrived_too=arrived_too).drop("timestamp_utc", "inserted_ts")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return stamps.found_stamps(spread(table(spark, sf, "raw_window").select("ingest_order", "station_id", "timestamp_utc", "inserted_ts")), table(spark, sf, "station_clocks"))


def p1_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with both instants."""
    return records(spark, sf).select("ingest_order", F.col("t_ms").alias("taken_ms"), F.col("n_ms").alias("arrived_ms"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return late.corrected_periods(late.late_counters(records(spark, sf, "precip_raw_mm"))).select("station_id", "period_start_min")


def p2_hourly_rain(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rainfall per station by reading time, as of the cut-off of 24 hours."""
    state = late.late_counters(records(spark, sf, "precip_raw_mm"), cutoffs_min=(1440,))
    return late.period_totals(state).select("station_id", "period_start_min", "readings", F.round("total", 4).alias("rain_mm"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_series(spark, sf).filter("filled").select("station_id", "slot_start_min")


def p3_series(spark: SparkSession, sf: str) -> DataFrame:
    """The half-hourly series per station, gaps imputed and marked."""
    return regular.regular_series(regular.bucketed(records(spark, sf, "precip_raw_mm", arrived_too=False)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = intervals.covered_and_gaps(intervals.qc_intervals(table(spark, sf, "avamet_cv_qc")))
    return rows.select("station_id", "kind", "start_min", "end_min")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(records(spark, sf, *spikes.FIELDS, arrived_too=False)).select("ingest_order", "field")


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each record and every inventory station within 2 km of its reported position."""
    raw = table(spark, sf, "raw_window").select(F.struct("ingest_order", "station_id").alias("record"), "lat", "lon")
    pairs = near.within(raw, table(spark, sf, "avamet_station_inventory_cv"), 2.0, "record", "station_id")
    return pairs.select("record.ingest_order", F.col("record.station_id").alias("own_station_id"), "station_id", F.round("distance_km", 6).alias("distance_km"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pairs(spark, sf).filter("NOT (station_id <=> own_station_id)").select("ingest_order", "station_id")


def p6_grid_cell(spark: SparkSession, sf: str) -> DataFrame:
    """The grid cell that holds each record's position."""
    edges = near.cell_edges(table(spark, sf, "cv_imerg_grid_cells"))
    rows = near.containing(table(spark, sf, "raw_window"), edges, "ingest_order")
    return rows.select("ingest_order", "region.lon_idx", "region.lat_idx")


QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p2_found, p2_hourly_rain, p3_found, p3_series, p4_found, p5_found, p6_found, p6_pairs, p6_grid_cell)}

_NEAR = """
WITH p AS (SELECT DISTINCT lat, lon FROM raw_window WHERE lat BETWEEN -90 AND 90 AND lon IS NOT NULL),
n AS (SELECT * FROM (SELECT p.lat, p.lon, s.station_id,
   2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS km
   FROM p JOIN avamet_station_inventory_cv s ON s.lat BETWEEN p.lat - 0.02 AND p.lat + 0.02) WHERE km <= 2.0)
SELECT r.ingest_order"""
ORACLES = stamp_sql.ORACLES | {
    "p6_pairs": _NEAR + ", r.station_id AS own_station_id, n.station_id, round(km, 6) AS distance_km FROM raw_window r JOIN n ON r.lat = n.lat AND r.lon = n.lon",
    "p6_found": _NEAR + ", n.station_id FROM raw_window r JOIN n ON r.lat = n.lat AND r.lon = n.lon WHERE n.station_id IS DISTINCT FROM r.station_id",
    "p4_found": """
WITH iv AS (
  SELECT station_id, date_trunc('month', timestamp_utc) AS month,
         CAST(floor(epoch(timestamp_utc) / 60) AS BIGINT) AS e, delta_prev_min AS d
  FROM avamet_cv_qc WHERE delta_prev_min > 0 AND station_id IS NOT NULL AND timestamp_utc IS NOT NULL),
s AS (SELECT station_id, month, e - d AS a, e,
             max(e) OVER (PARTITION BY station_id, month ORDER BY e - d, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, month ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS k FROM s),
m AS (SELECT station_id, month, k, min(a) AS a, max(e) AS e FROM g GROUP BY ALL),
n AS (SELECT *, lead(a) OVER (PARTITION BY station_id, month ORDER BY a) AS f FROM m)
SELECT station_id, 'covered' AS kind, a AS start_min, e AS end_min FROM n
UNION ALL SELECT station_id, 'gap', e, f FROM n WHERE f IS NOT NULL""",
    "p6_grid_cell": """
SELECT r.ingest_order, c.lon_idx, c.lat_idx FROM raw_window r JOIN cv_imerg_grid_cells c
  ON r.lon >= round(c.lon - 0.05, 6) AND r.lon < round(c.lon + 0.05, 6)
 AND r.lat >= round(c.lat - 0.05, 6) AND r.lat < round(c.lat + 0.05, 6)""",
}
