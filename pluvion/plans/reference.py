"""Queries of the gauge and grid verification over the given tables, with the DuckDB SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.functions import scalars
from pluvion.operators import events as ev
from pluvion.operators import intervals as iv_ops
from pluvion.operators import near, spatial, verify
from pluvion.operators import qc as qc_ops
from pluvion.operators import windows as win_ops
from pluvion.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- shared inputs (Spark)


def checked(spark: SparkSession, sf: str) -> DataFrame:
    return qc_ops.qc(table(spark, sf, "avamet_cv_qc"))


def iv(spark: SparkSession, sf: str) -> DataFrame:
    return win_ops.intervals(checked(spark, sf))


def shared(spark: SparkSession, sf: str) -> DataFrame:
    """The intervals, stored: for queries that use them more than once."""
    return cut(iv(spark, sf))


def win(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return win_ops.trailing_windows(iv(spark, sf) if base is None else base)


def catalog(spark: SparkSession, sf: str, base: DataFrame | None = None, mode: str = "loose") -> DataFrame:
    w = cut(win(spark, sf, base))
    return cut(ev.event_catalog(w, ev.pot_thresholds(w, mode=mode), mode))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "avamet_station_inventory_cv").filter("lat IS NOT NULL AND lon IS NOT NULL")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_axis_cells(stations(spark, sf), table(spark, sf, "cv_imerg_grid_cells")).select("station_id", "lon_idx", "lat_idx")


def grid(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return cut(verify.smoothed_grid(win_ops.half_hour_bins(iv(spark, sf) if base is None else base), cells(spark, sf)))


def matched(spark: SparkSession, sf: str, base: DataFrame | None = None, peaks: bool = False) -> DataFrame:
    base = shared(spark, sf) if base is None else base
    return cut(verify.event_match(catalog(spark, sf, base), cells(spark, sf), grid(spark, sf, base), peaks))


# ---------------------------------------------------------------- shared inputs (SQL, formulated independently)

QC = """
dd AS (SELECT * EXCLUDE (k) FROM (SELECT station_id, timestamp_utc, inserted_ts, precip_raw_mm AS p, precip_sum_raw_mm AS s,
  row_number() OVER (PARTITION BY station_id, timestamp_utc ORDER BY inserted_ts DESC NULLS LAST, precip_raw_mm DESC NULLS LAST, precip_sum_raw_mm DESC NULLS LAST) AS k
  FROM avamet_cv_qc WHERE station_id IS NOT NULL AND timestamp_utc IS NOT NULL) WHERE k = 1),
sq AS (SELECT *, lag(timestamp_utc) OVER w AS pt, lead(timestamp_utc) OVER w AS nt, lag(p) OVER w AS pp, lead(p) OVER w AS np, lag(s) OVER w AS ps FROM dd WINDOW w AS (PARTITION BY station_id ORDER BY timestamp_utc)),
dl AS (SELECT *, CAST(floor(epoch(timestamp_utc) / 60) AS BIGINT) AS end_min, date_diff('minute', pt, timestamp_utc) AS d, date_diff('minute', timestamp_utc, nt) AS dn, s - ps AS ds FROM sq),
rt AS (SELECT *, CASE WHEN d > 0 THEN p * 60.0::DOUBLE / d END AS rate FROM dl),
qc AS (SELECT station_id, timestamp_utc, end_min, p, s, d AS delta_prev_min, dn AS delta_next_min, ds AS d_precsum_mm, rate AS precip_rate_mmh_raw,
  CASE WHEN d IN (5, 10) THEN true ELSE false END AS is_core_cadence, CASE WHEN d IN (4, 5, 6, 10, 15, 20, 30) THEN true ELSE false END AS is_supported_cadence,
  CASE WHEN d <= 0 THEN true ELSE false END AS flag_delta_nonpositive, CASE WHEN d >= 60 THEN true ELSE false END AS flag_gap_large,
  CASE WHEN p < 0 THEN true ELSE false END AS flag_precip_negative, CASE WHEN rate >= 200 THEN true ELSE false END AS flag_precip_suspect_rate, CASE WHEN rate >= 1000 THEN true ELSE false END AS flag_precip_hard_rate,
  CASE WHEN rate >= 200 AND coalesce(pp, 0) <= 0.1::DOUBLE AND coalesce(np, 0) <= 0.1::DOUBLE THEN true ELSE false END AS flag_precip_isolated_spike,
  CASE WHEN s < 0 THEN true ELSE false END AS flag_precsum_negative, CASE WHEN s >= 100000 THEN true ELSE false END AS flag_precsum_absurd,
  CASE WHEN ds < -0.001::DOUBLE THEN true ELSE false END AS flag_precsum_decrease, CASE WHEN abs(ds - p) > 0.2::DOUBLE THEN true ELSE false END AS flag_precsum_mismatch,
  CASE WHEN p < 0 OR rate >= 1000 THEN NULL ELSE p END AS precip_mm_qc, CASE WHEN p < 0 OR rate >= 1000 OR d IS NULL OR d <= 0 THEN NULL ELSE p * 60.0::DOUBLE / d END AS precip_rate_mmh_qc,
  CASE WHEN s < 0 OR s >= 100000 THEN NULL ELSE s END AS precip_sum_mm_qc,
  CASE WHEN p < 0 OR rate >= 1000 THEN 'FAIL' WHEN rate >= 200 THEN 'SUSPECT' ELSE 'PASS' END AS qc_precip,
  CASE WHEN s < 0 OR s >= 100000 THEN 'FAIL' WHEN ds < -0.001::DOUBLE OR abs(ds - p) > 0.2::DOUBLE THEN 'SUSPECT' ELSE 'PASS' END AS qc_precsum,
  CASE WHEN d IN (4, 5, 6, 10, 15, 20, 30) AND p >= 0 AND NOT rate >= 1000 THEN true ELSE false END AS usable FROM rt)"""
IV = QC + """,
iv AS (SELECT station_id, end_min, max(dur) AS dur, sum(CASE WHEN usable THEN coalesce(precip_mm_qc, 0) ELSE 0 END) AS um, sum(CASE WHEN usable THEN dur ELSE 0 END) AS ud,
  count(*) FILTER (WHERE dur > 0 AND (qc_precip = 'FAIL' OR qc_precsum = 'FAIL')) AS fails, count(*) FILTER (WHERE dur > 0 AND (qc_precip = 'SUSPECT' OR qc_precsum = 'SUSPECT')) AS suspects,
  count(*) FILTER (WHERE dur > 0) AS intervals, count(*) FILTER (WHERE dur > 0 AND usable) AS usables
  FROM (SELECT *, CASE WHEN delta_prev_min > 0 THEN delta_prev_min ELSE 0 END AS dur FROM qc) GROUP BY ALL)"""
# windows by an overlap join instead of running sums
WIN = IV + """,
ws AS (SELECT unnest([30, 60, 180, 360]) AS window_min),
ov AS (SELECT r.station_id, r.end_min, w.window_min, i.*  EXCLUDE (station_id, end_min),
  CASE WHEN i.dur > 0 THEN (i.end_min - greatest(i.end_min - i.dur, r.end_min - w.window_min)) / i.dur::DOUBLE ELSE 0 END AS part
  FROM iv r CROSS JOIN ws w JOIN iv i ON i.station_id = r.station_id AND i.end_min > r.end_min - w.window_min AND i.end_min <= r.end_min),
wa AS (SELECT station_id, end_min, window_min, round(sum(um * part), 6) AS accum_mm, sum(ud * part) AS um_, CAST(sum(fails) AS BIGINT) AS fail_count, CAST(sum(suspects) AS BIGINT) AS suspect_count, CAST(sum(intervals) AS BIGINT) AS interval_count, CAST(sum(usables) AS BIGINT) AS usable_count,
  CAST(mode(dur ORDER BY dur) FILTER (WHERE dur IN (4, 5, 6, 10, 15, 20, 30)) AS BIGINT) AS md FROM ov GROUP BY ALL),
win AS (SELECT *, round(greatest(0, least(1, um_ / window_min)), 9) AS coverage_ratio, round(um_, 6) AS usable_minutes, round(greatest(0, least(1, um_ / window_min)), 9) >= 0.95::DOUBLE AND fail_count = 0 AS complete_strict,
  round(greatest(0, least(1, um_ / window_min)), 9) >= 0.8::DOUBLE AS complete_loose FROM wa)"""
THR = WIN + """,
thr AS (SELECT station_id, window_min, count(*) AS n_rows, count(*) FILTER (WHERE complete_strict) AS n_complete_strict, count(*) FILTER (WHERE complete_loose) AS n_complete_loose,
  count(*) FILTER (WHERE complete_loose) AS n_complete_used, count(*) FILTER (WHERE complete_loose AND accum_mm > 0) AS n_wet_windows_used,
  round(quantile_cont(accum_mm, 0.995) FILTER (WHERE complete_loose AND accum_mm > 0), 6) AS threshold_mm, round(quantile_cont(coverage_ratio, 0.5), 6) AS median_coverage_ratio,
  round(quantile_cont(coverage_ratio, 0.95), 6) AS p95_coverage_ratio, round(quantile_cont(accum_mm, 0.99) FILTER (WHERE complete_strict), 6) AS p99_accum_mm_strict, max(accum_mm) FILTER (WHERE complete_strict) AS max_accum_mm_strict
  FROM win GROUP BY station_id, window_min)"""
EV = THR + """,
hot AS (SELECT w.*, t.threshold_mm FROM win w JOIN thr t USING (station_id, window_min) WHERE complete_loose AND accum_mm > 0 AND accum_mm >= threshold_mm),
br AS (SELECT *, CASE WHEN end_min - lag(end_min) OVER (PARTITION BY station_id, window_min ORDER BY end_min) > CASE WHEN window_min <= 60 THEN 360 ELSE 720 END THEN 1 ELSE 0 END AS b FROM hot),
cl AS (SELECT *, CAST(sum(b) OVER (PARTITION BY station_id, window_min ORDER BY end_min ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id FROM br),
pk AS (SELECT *, row_number() OVER (PARTITION BY station_id, window_min, cluster_id ORDER BY accum_mm DESC, end_min) AS k, count(*) OVER c AS cluster_size, min(end_min) OVER c AS cluster_start_min, max(end_min) OVER c AS cluster_end_min FROM cl WINDOW c AS (PARTITION BY station_id, window_min, cluster_id)),
ev AS (SELECT station_id, window_min, end_min, accum_mm AS event_accum_mm, round(accum_mm * 60 / window_min, 6) AS event_rate_mmh, threshold_mm, coverage_ratio, fail_count, suspect_count, cluster_id, cluster_size, cluster_start_min, cluster_end_min,
  cluster_end_min - cluster_start_min AS cluster_span_min, round(accum_mm / threshold_mm, 6) AS window_rank_ratio FROM pk WHERE k = 1)"""
ST = "st AS (SELECT * FROM avamet_station_inventory_cv WHERE lat IS NOT NULL AND lon IS NOT NULL)"
KM = "(2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
NB = ST + f""",
nb AS (SELECT * FROM (SELECT a.station_id, b.station_id AS neighbour_id, {KM.format(a='a', b='b')} AS km FROM st a JOIN st b ON a.station_id <> b.station_id) WHERE km > 1e-9 AND km <= 15)"""
CELL = ST + """,
cell AS (SELECT s.station_id, (SELECT c.lon_idx FROM cv_imerg_grid_cells c ORDER BY round(abs(s.lon - c.lon), 9), c.lon_idx LIMIT 1) AS lon_idx, (SELECT c.lat_idx FROM cv_imerg_grid_cells c ORDER BY round(abs(s.lat - c.lat), 9), c.lat_idx LIMIT 1) AS lat_idx FROM st s)"""
BIN = IV + """,
bn AS (SELECT station_id, bin, sum(um * o / dur) AS mass, sum(ud * o / dur) AS minutes, max(CASE WHEN fails > 0 THEN 1 ELSE 0 END) AS fail
  FROM (SELECT *, least(end_min, bin * 30 + 30) - greatest(end_min - dur, bin * 30) AS o FROM (SELECT *, unnest(range((end_min - dur) // 30, (end_min - 1) // 30 + 1)) AS bin FROM iv WHERE dur > 0)) GROUP BY station_id, bin)"""
# the regular timeline by an overlap join of intervals and reference ends
REF = BIN + """,
ws2 AS (SELECT unnest([30, 60, 180, 360]) AS window_min),
ref AS (SELECT r.station_id, r.bin * 30 + 30 AS ref_end, window_min, round(sum(b.mass), 6) AS accum_mm, round(least(1, sum(b.minutes) / window_min), 9) AS coverage_ratio,
  round(least(1, sum(b.minutes) / window_min), 9) >= 0.95::DOUBLE AND max(b.fail) = 0 AS strict
  FROM bn r CROSS JOIN ws2 JOIN bn b ON b.station_id = r.station_id AND b.bin > r.bin - window_min // 30 AND b.bin <= r.bin GROUP BY r.station_id, r.bin, window_min)"""
GRID = """,
off AS (SELECT unnest([-1, 0, 1]) AS o),
nine AS (SELECT station_id, lon_idx + a.o AS lon_idx, lat_idx + b.o AS lat_idx, a.o AS di, b.o AS dj FROM cell, off a, off b),
grid AS (SELECT bin + 1 AS step, lon_idx, lat_idx, round(avg(mass * 2 * (1 + 0.1::DOUBLE * di - 0.05::DOUBLE * dj)), 9) AS rate FROM bn JOIN nine USING (station_id) WHERE fail = 0 AND minutes >= 15 GROUP BY ALL)"""
EVC = """,
es AS (SELECT station_id, window_min, end_min, event_accum_mm, unnest(range((end_min - window_min) // 30, (end_min - 1) // 30 + 1)) AS step FROM ev),
eo AS (SELECT *, least(end_min, step * 30 + 30) - greatest(end_min - window_min, step * 30) AS o FROM es WHERE step IN (SELECT step FROM grid)),
ec AS (SELECT e.station_id, window_min, end_min, di, dj, max(event_accum_mm) AS event_accum_mm, sum(rate * o / 60.0::DOUBLE) AS mm, max(rate) AS peak, count(rate) AS valid, sum(o) AS minutes, count(*) AS steps, count(*) FILTER (WHERE rate > 0) AS positive
  FROM eo e JOIN nine n ON n.station_id = e.station_id LEFT JOIN grid g ON g.step = e.step AND g.lon_idx = n.lon_idx AND g.lat_idx = n.lat_idx GROUP BY ALL),
mt AS (SELECT e.station_id, e.window_min, e.end_min, e.event_accum_mm, grid_mm, grid3x3_mm, grid_peak_mmh, coalesce(gs, 0) AS grid_steps, positive_steps, positive_steps_3x3,
  CAST(floor((e.end_min - 1) / 30) - ceil((e.end_min - e.window_min - 29) / 30) + 1 AS BIGINT) AS expected_steps, round(coalesce(minutes, 0) / e.window_min, 6) AS grid_coverage
  FROM ev e LEFT JOIN (SELECT station_id, window_min, end_min, round(coalesce(max(mm) FILTER (WHERE di = 0 AND dj = 0), 0), 6) AS grid_mm, round(coalesce(max(mm), 0), 6) AS grid3x3_mm, max(peak) FILTER (WHERE di = 0 AND dj = 0) AS grid_peak_mmh, max(steps) AS gs, max(minutes) AS minutes,
    coalesce(max(positive) FILTER (WHERE di = 0 AND dj = 0), 0) AS positive_steps, coalesce(max(positive), 0) AS positive_steps_3x3 FROM ec GROUP BY ALL) g USING (station_id, window_min, end_min)),
matched AS (SELECT *, greatest(0, expected_steps - grid_steps) AS missing_steps, expected_steps > 0 AND expected_steps - grid_steps <= 0 AND grid_coverage >= 0.999::DOUBLE AS complete_window FROM mt)"""
CELL_ONLY = CELL.removeprefix(ST + ",")
MATCHED = EV + ",\n" + CELL + BIN.removeprefix(IV) + GRID + EVC


def sql(base: str, select: str) -> str:
    return "WITH " + base.strip() + "\n" + select


# ---------------------------------------------------------------- inventory, quality control


@query("""SELECT station_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n_obs, count(precip_raw_mm) AS n_precip FROM raw_window WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY station_id""")
def station_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "raw_window").filter("lat IS NOT NULL AND lon IS NOT NULL")
    return rows.groupBy("station_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("n_obs"), F.count("precip_raw_mm").alias("n_precip"))


@query("""SELECT r.ingest_order, r.station_id, s.alt AS station_alt FROM raw_window r JOIN avamet_station_inventory_cv s USING (station_id) WHERE s.inside_cv""")
def station_filter_join(spark: SparkSession, sf: str) -> DataFrame:
    inside = table(spark, sf, "avamet_station_inventory_cv").filter("inside_cv").select("station_id", F.col("alt").alias("station_alt"))
    return table(spark, sf, "raw_window").select("ingest_order", "station_id").join(inside, "station_id").select("ingest_order", "station_id", "station_alt")


@query("""SELECT event_id, TRY_CAST(replace(nullif(nullif(trim(json_extract_string(props, '$.k')), ''), 'None'), ',', '.') AS DOUBLE) AS k FROM events""")
def json_numeric_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.json_number("props", "k").alias("k"))


@query(sql(QC, "SELECT station_id, count(*) AS readings, round(sum(p), 4) AS precip_mm, count(inserted_ts) AS n_inserted FROM dd GROUP BY station_id"))
def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    kept = qc_ops.dedup_latest(table(spark, sf, "avamet_cv_qc").select(*qc_ops.OBS).filter("station_id IS NOT NULL AND timestamp_utc IS NOT NULL"))
    return kept.groupBy("station_id").agg(F.count("*").alias("readings"), F.round(F.sum("precip_raw_mm"), 4).alias("precip_mm"), F.count("inserted_ts").alias("n_inserted"))


FLAGS = ["is_core_cadence", "is_supported_cadence", "flag_delta_nonpositive", "flag_gap_large", "flag_precip_negative", "flag_precip_suspect_rate", "flag_precip_hard_rate", "flag_precip_isolated_spike", "flag_precsum_negative", "flag_precsum_absurd", "flag_precsum_decrease", "flag_precsum_mismatch"]


@query(sql(QC, f"SELECT station_id, CAST(epoch_us(timestamp_utc) AS BIGINT) AS at_us, delta_prev_min, delta_next_min, {', '.join(FLAGS)} FROM qc"))
def qc_flags(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).select("station_id", F.expr("unix_micros(cast(timestamp_utc AS timestamp))").alias("at_us"), "delta_prev_min", "delta_next_min", *FLAGS)


@query(sql(QC, "SELECT station_id, CAST(epoch_us(timestamp_utc) AS BIGINT) AS at_us, qc_precip, qc_precsum, round(precip_mm_qc, 6) AS precip_mm_qc, round(precip_rate_mmh_qc, 6) AS precip_rate_mmh_qc, round(precip_sum_mm_qc, 6) AS precip_sum_mm_qc, round(d_precsum_mm, 6) AS d_precsum_mm FROM qc"))
def qc_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return checked(spark, sf).select("station_id", F.expr("unix_micros(cast(timestamp_utc AS timestamp))").alias("at_us"), "qc_precip", "qc_precsum", r("precip_mm_qc"), r("precip_rate_mmh_qc"), r("precip_sum_mm_qc"), r("d_precsum_mm"))


@query(sql(QC, "SELECT station_id, end_min, delta_prev_min, round(precip_mm_qc, 6) AS precip_mm FROM qc WHERE usable"))
def usable_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).filter("usable_interval_extremes").select("station_id", "end_min", "delta_prev_min", F.round("precip_mm_qc", 6).alias("precip_mm"))


@query(sql(QC, """SELECT station_id, count(*) AS n_rows, count(*) FILTER (WHERE qc_precip = 'FAIL') AS n_precip_fail, count(*) FILTER (WHERE qc_precip = 'SUSPECT') AS n_precip_suspect, count(*) FILTER (WHERE qc_precsum = 'FAIL') AS n_precsum_fail,
  count(*) FILTER (WHERE qc_precsum = 'SUSPECT') AS n_precsum_suspect, count(*) FILTER (WHERE flag_gap_large) AS n_gap_large, count(*) FILTER (WHERE usable) AS n_usable_interval_extremes, CAST(quantile_cont(delta_prev_min, 0.5) AS DOUBLE) AS median_delta_min,
  round(CAST(quantile_cont(delta_prev_min, 0.95) AS DOUBLE), 6) AS p95_delta_min, round(quantile_cont(precip_rate_mmh_qc, 0.99), 6) AS p99_precip_rate_mmh_qc, round(max(precip_rate_mmh_raw), 6) AS max_precip_rate_mmh_raw, max(p) AS max_precip_raw_mm FROM qc GROUP BY station_id"""))
def qc_station_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.sum(F.expr(f"CAST(({c}) AS BIGINT)"))
    return checked(spark, sf).groupBy("station_id").agg(
        F.count("*").alias("n_rows"), n("qc_precip = 'FAIL'").alias("n_precip_fail"), n("qc_precip = 'SUSPECT'").alias("n_precip_suspect"), n("qc_precsum = 'FAIL'").alias("n_precsum_fail"), n("qc_precsum = 'SUSPECT'").alias("n_precsum_suspect"),
        n("flag_gap_large").alias("n_gap_large"), n("usable_interval_extremes").alias("n_usable_interval_extremes"), F.percentile("delta_prev_min", 0.5).alias("median_delta_min"), F.round(F.percentile("delta_prev_min", 0.95), 6).alias("p95_delta_min"),
        F.round(F.percentile("precip_rate_mmh_qc", 0.99), 6).alias("p99_precip_rate_mmh_qc"), F.round(F.max("precip_rate_mmh_raw"), 6).alias("max_precip_rate_mmh_raw"), F.max("precip_raw_mm").alias("max_precip_raw_mm"),
    )


@query(sql(QC, """SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, (SELECT count(*) FROM avamet_cv_qc) - count(*) AS n_replaced, count(*) FILTER (WHERE qc_precip = 'FAIL') AS n_fail, max(p) AS max_precip_raw_mm, round(avg(CASE WHEN usable THEN 1.0 ELSE 0.0 END), 6) AS usable_share FROM qc"""))
def qc_global_summary(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "avamet_cv_qc").agg(F.count("*").alias("n_all"))
    one = checked(spark, sf).agg(
        F.count("*").alias("n_rows"), F.count_distinct("station_id").alias("n_stations"), F.sum(F.expr("CAST(qc_precip = 'FAIL' AS BIGINT)")).alias("n_fail"), F.max("precip_raw_mm").alias("max_precip_raw_mm"),
        F.round(F.avg(F.expr("CASE WHEN usable_interval_extremes THEN 1.0D ELSE 0.0D END")), 6).alias("usable_share"),
    )
    return spark.sql("SELECT n_rows, n_stations, (SELECT n_all FROM {t}) - n_rows AS n_replaced, n_fail, max_precip_raw_mm, usable_share FROM {o}", t=total, o=one)


@query(sql(QC, "SELECT station_id, count(*) FILTER (WHERE qc_precip <> 'PASS' OR qc_precsum <> 'PASS') AS n_bad, count(*) AS n_rows FROM qc GROUP BY station_id ORDER BY n_bad DESC, station_id LIMIT 10"))
def worst_stations(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.sum(F.expr("CAST(qc_precip <> 'PASS' OR qc_precsum <> 'PASS' AS BIGINT)"))
    return checked(spark, sf).groupBy("station_id").agg(bad.alias("n_bad"), F.count("*").alias("n_rows")).orderBy(F.col("n_bad").desc(), "station_id").limit(10)


# ---------------------------------------------------------------- windows, events

WCOLS = ["accum_mm", "coverage_ratio", "fail_count", "suspect_count", "interval_count", "usable_count", "usable_minutes", "complete_strict", "complete_loose"]


def _window_query(w: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return win_ops.trailing_windows(iv(spark, sf), (w,)).select("station_id", "end_min", *WCOLS)

    run.__name__ = f"window_metrics_{w}"
    return query(sql(WIN, f"SELECT station_id, end_min, {', '.join(WCOLS)} FROM win WHERE window_min = {w}"))(run)


for _w in win_ops.WINDOWS:
    _window_query(_w)


@query(sql(WIN, """, dc AS (SELECT station_id, end_min, window_min, dur, sum(intervals) AS n FROM ov WHERE dur IN (4, 5, 6, 10, 15, 20, 30) GROUP BY ALL HAVING sum(intervals) > 0),
dk AS (SELECT *, row_number() OVER (PARTITION BY station_id, end_min, window_min ORDER BY n DESC, dur) AS k FROM dc)
SELECT w.station_id, w.end_min, w.window_min, CAST(dk.dur AS BIGINT) AS dominant_cadence_min FROM win w LEFT JOIN dk ON dk.k = 1 AND dk.station_id = w.station_id AND dk.end_min = w.end_min AND dk.window_min = w.window_min"""))
def dominant_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return win(spark, sf).select("station_id", "end_min", "window_min", "dominant_cadence_min")


@query(sql(WIN, """SELECT station_id, window_min, count(*) AS n_windows, count(*) FILTER (WHERE complete_strict) AS n_complete_strict, count(*) FILTER (WHERE complete_loose) AS n_complete_loose, count(*) FILTER (WHERE fail_count > 0) AS n_with_fail,
  count(*) FILTER (WHERE suspect_count > 0) AS n_with_suspect, round(quantile_cont(coverage_ratio, 0.5), 6) AS median_coverage, round(quantile_cont(coverage_ratio, 0.95), 6) AS p95_coverage FROM win GROUP BY ALL"""))
def window_completeness(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.sum(F.expr(f"CAST({c} AS BIGINT)"))
    return win(spark, sf).groupBy("station_id", "window_min").agg(
        F.count("*").alias("n_windows"), n("complete_strict").alias("n_complete_strict"), n("complete_loose").alias("n_complete_loose"), n("(fail_count > 0)").alias("n_with_fail"), n("(suspect_count > 0)").alias("n_with_suspect"),
        F.round(F.percentile("coverage_ratio", 0.5), 6).alias("median_coverage"), F.round(F.percentile("coverage_ratio", 0.95), 6).alias("p95_coverage"),
    )


@query(sql(THR, "SELECT * FROM thr"))
def pot_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return ev.pot_thresholds(win(spark, sf))


@query(sql(EV, "SELECT * FROM ev"))
def event_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf)


@query(sql(EV, """, pe AS (SELECT t.station_id, t.window_min, t.n_complete_used, greatest(1, ceil(t.n_complete_used / (365.25::DOUBLE * 24 * 60 / t.window_min))) AS years_active, count(e.end_min) AS n_events FROM thr t LEFT JOIN ev e USING (station_id, window_min) GROUP BY ALL)
SELECT window_min, count(*) FILTER (WHERE n_complete_used > 0) AS n_active_stations, count(*) FILTER (WHERE n_events > 0) AS n_eventful_stations, CAST(sum(n_events) AS BIGINT) AS n_events, round(CAST(quantile_cont(n_events / years_active, 0.5) AS DOUBLE), 6) AS median_events_per_year FROM pe GROUP BY window_min"""))
def catalog_scale_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = cut(win(spark, sf))
    thr = cut(ev.pot_thresholds(w))
    n = ev.event_catalog(w, thr).groupBy("station_id", "window_min").agg(F.count("*").alias("n_events"))
    years = F.expr("greatest(1D, ceil(n_complete_used / (365.25D * 24 * 60 / window_min)))")
    rows = thr.join(n, ["station_id", "window_min"], "left").withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "years": years})
    return rows.groupBy("window_min").agg(
        F.sum(F.expr("CAST(n_complete_used > 0 AS BIGINT)")).alias("n_active_stations"), F.sum(F.expr("CAST(n_events > 0 AS BIGINT)")).alias("n_eventful_stations"), F.sum("n_events").alias("n_events"),
        F.round(F.percentile(F.col("n_events") / F.col("years"), 0.5), 6).alias("median_events_per_year"),
    )


# ---------------------------------------------------------------- geometry


@query(sql(NB, "SELECT station_id, neighbour_id, round(km, 6) AS distance_km FROM nb"))
def neighbor_radius(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.radius_neighbours(stations(spark, sf)).select("station_id", "neighbour_id", F.round("distance_km", 6).alias("distance_km"))


KNN = ST + f""",
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(km, 9), neighbour_id) AS neighbour_rank FROM (SELECT a.station_id, b.station_id AS neighbour_id, {KM.format(a='a', b='b')} AS km FROM st a JOIN st b ON a.station_id <> b.station_id)) WHERE neighbour_rank <= 3)"""


@query(sql(KNN, "SELECT station_id, neighbour_id, neighbour_rank, round(km, 6) AS distance_km FROM kn"))
def neighbor_knn(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_neighbours(stations(spark, sf)).select("station_id", "neighbour_id", "neighbour_rank", F.round("distance_km", 6).alias("distance_km"))


@query(sql(CELL, "SELECT * FROM cell"))
def nearest_cell(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf)


@query(sql(ST, """SELECT station_id, lon_idx, lat_idx FROM (SELECT s.station_id, c.lon_idx, c.lat_idx, row_number() OVER (PARTITION BY s.station_id ORDER BY round(pow(s.lon - c.lon, 2) + pow(s.lat - c.lat, 2), 9), c.lon_idx, c.lat_idx) AS k FROM st s, cv_imerg_grid_cells c WHERE c.inside_cv_polygon) WHERE k = 1"""))
def nearest_cell_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_inside_cells(stations(spark, sf), table(spark, sf, "cv_imerg_grid_cells")).select("station_id", "lon_idx", "lat_idx")


@query(sql(ST, """SELECT s.station_id, c.lon_idx, c.lat_idx FROM st s JOIN cv_imerg_grid_cells c ON c.inside_cv_polygon AND s.lon >= round(c.lon - 0.05, 6) AND s.lon < round(c.lon + 0.05, 6) AND s.lat >= round(c.lat - 0.05, 6) AND s.lat < round(c.lat + 0.05, 6)"""))
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    edges = near.cell_edges(table(spark, sf, "cv_imerg_grid_cells").filter("inside_cv_polygon"))
    return near.containing(stations(spark, sf), edges, "station_id").select("station_id", "region.lon_idx", "region.lat_idx")


@query(sql(ST, "SELECT station_id FROM st WHERE lon BETWEEN (SELECT min(lon) FROM cv_imerg_grid_cells WHERE inside_cv_polygon) AND (SELECT max(lon) FROM cv_imerg_grid_cells WHERE inside_cv_polygon) AND lat BETWEEN (SELECT min(lat) FROM cv_imerg_grid_cells WHERE inside_cv_polygon) AND (SELECT max(lat) FROM cv_imerg_grid_cells WHERE inside_cv_polygon)"))
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    box = table(spark, sf, "cv_imerg_grid_cells").filter("inside_cv_polygon").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    return spark.sql("SELECT station_id FROM {s} WHERE lon BETWEEN (SELECT a FROM {x}) AND (SELECT b FROM {x}) AND lat BETWEEN (SELECT c FROM {x}) AND (SELECT d FROM {x})", s=stations(spark, sf), x=box)


# ---------------------------------------------------------------- support, audit

SUP = EV + ",\n" + NB + """,
sp AS (SELECT e.station_id, e.window_min, e.end_min, count(n.neighbour_id) AS neighbour_candidates, count(n.neighbour_id) FILTER (WHERE hit) AS neighbour_supporting, round(min(km) FILTER (WHERE hit), 6) AS nearest_support_km
  FROM ev e LEFT JOIN (SELECT n.*, e2.window_min, e2.end_min, EXISTS (SELECT 1 FROM iv i WHERE i.station_id = n.neighbour_id AND i.um > 0 AND i.end_min BETWEEN e2.end_min - e2.window_min - CASE WHEN e2.window_min <= 60 THEN 30 ELSE 60 END AND e2.end_min + CASE WHEN e2.window_min <= 60 THEN 30 ELSE 60 END) AS hit
    FROM nb n JOIN ev e2 USING (station_id)) n USING (station_id, window_min, end_min) GROUP BY ALL)"""


def supported(spark: SparkSession, sf: str) -> DataFrame:
    base = shared(spark, sf)
    neighbours = spatial.radius_neighbours(stations(spark, sf)).select("station_id", "neighbour_id", "distance_km")
    return ev.neighbour_support(catalog(spark, sf, base), neighbours, base)


@query(sql(SUP, "SELECT *, neighbour_supporting > 0 AS neighbour_support FROM sp"))
def neighbor_support(spark: SparkSession, sf: str) -> DataFrame:
    return supported(spark, sf)


@query(sql(SUP, "SELECT window_min, count(*) AS n_events, round(100.0::DOUBLE * count(*) FILTER (WHERE neighbour_supporting > 0) / count(*), 6) AS supported_pct, CAST(quantile_cont(neighbour_candidates, 0.5) AS DOUBLE) AS median_candidates, round(quantile_cont(nearest_support_km, 0.5), 5) AS median_support_km FROM sp GROUP BY window_min"))
def support_scale_summary(spark: SparkSession, sf: str) -> DataFrame:
    return supported(spark, sf).groupBy("window_min").agg(
        F.count("*").alias("n_events"), F.round(100.0 * F.sum(F.col("neighbour_support").cast("int")) / F.count("*"), 6).alias("supported_pct"), F.percentile("neighbour_candidates", 0.5).alias("median_candidates"), F.round(F.percentile("nearest_support_km", 0.5), 5).alias("median_support_km"),
    )


TOP = EV + """,
tp AS (SELECT * FROM (SELECT station_id, window_min, end_min, event_accum_mm, row_number() OVER (PARTITION BY window_min ORDER BY event_accum_mm DESC, end_min, station_id) AS rank FROM ev) WHERE rank <= 10)"""


def top(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    return ev.top_per_group(catalog(spark, sf, base).select("station_id", "window_min", "end_min", "event_accum_mm"), ["window_min"], [F.col("event_accum_mm").desc(), F.col("end_min"), F.col("station_id")], 10)


@query(sql(TOP, "SELECT * FROM tp"))
def top_events(spark: SparkSession, sf: str) -> DataFrame:
    return top(spark, sf)


AUD = TOP + ",\n" + KNN + """,
au AS (SELECT t.station_id, t.window_min, t.end_min, t.rank, k.neighbour_rank, k.neighbour_id, round(k.km, 6) AS distance_km, round(sum(i.um * part), 6) AS neighbour_accum_mm, round(coalesce(sum(i.ud * part), 0) / t.window_min, 6) AS neighbour_coverage, count(i.end_min) AS neighbour_intervals
  FROM tp t JOIN kn k USING (station_id) LEFT JOIN LATERAL (SELECT end_min, um, ud, (end_min - greatest(end_min - dur, t.end_min - t.window_min)) / dur::DOUBLE AS part FROM iv WHERE dur > 0 AND station_id = k.neighbour_id AND end_min > t.end_min - t.window_min AND end_min <= t.end_min) i ON true GROUP BY t.station_id, t.window_min, t.end_min, t.rank, k.neighbour_rank, k.neighbour_id, k.km)"""


def audited(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    base = shared(spark, sf) if base is None else base
    return ev.audit(top(spark, sf, base), spatial.nearest_neighbours(stations(spark, sf)), base)


@query(sql(AUD, "SELECT * FROM au"))
def event_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audited(spark, sf)


@query(sql(TOP, """, o AS (SELECT station_id, end_min - window_min AS a, end_min AS e, max(end_min) OVER (PARTITION BY station_id ORDER BY end_min - window_min, end_min ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tp),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT station_id, min(a) AS start_min, max(e) AS end_min FROM g GROUP BY station_id, k"""))
def merged_request_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = top(spark, sf).select("station_id", (F.col("end_min") - F.col("window_min")).alias("start_min"), "end_min")
    return iv_ops.merge_intervals(rows, ["station_id"]).select("station_id", "start_min", "end_min")


# ---------------------------------------------------------------- grid


@query(sql(IV, """, f AS (SELECT DISTINCT CASE WHEN dur > 10 THEN 'archive/late/' ELSE 'archive/' END || station_id || '/field.' || strftime(make_timestamp((end_min // 30 * 30) * 60000000), '%Y%m%d-S%H%M%S') || '-E' || strftime(make_timestamp((end_min // 30 * 30 + 29) * 60000000 + 59000000), '%H%M%S') || '.nc' AS path FROM iv),
p AS (SELECT path, regexp_extract(path, '(\\d{8}-S\\d{6})-E\\d{6}', 1) AS start, length(path) - length(replace(path, '/', '')) AS depth FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth DESC, path) AS k, count(*) OVER (PARTITION BY start) AS files FROM p)
SELECT start AS step_start, path, files FROM k WHERE k = 1"""))
def file_timeline_index(spark: SparkSession, sf: str) -> DataFrame:
    """One file per half-hour step, the deepest path first, then by name; names put together from the stored intervals."""
    half = F.expr("end_min div 30 * 30")
    name = F.concat(F.when(F.col("dur") > 10, "archive/late/").otherwise("archive/"), "station_id", F.lit("/field."), F.date_format(F.timestamp_seconds(half * 60), "yyyyMMdd-'S'HHmmss"), F.lit("-E"), F.date_format(F.timestamp_seconds((half + 29) * 60 + 59), "HHmmss"), F.lit(".nc"))
    paths = iv(spark, sf).select(name.alias("path")).distinct()
    rows = paths.select("path", F.regexp_extract("path", r"(\d{8}-S\d{6})-E\d{6}", 1).alias("step_start"), F.length(F.regexp_replace("path", "[^/]", "")).alias("depth"))
    # the smallest of (-depth, path) by partial aggregation instead of a window
    return rows.groupBy("step_start").agg(F.min(F.struct((-F.col("depth")).alias("d"), "path"))["path"].alias("path"), F.count("*").alias("files"))


@query(sql(MATCHED, "SELECT * FROM matched"))
def event_grid_match(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


_SKILL = """count(*) AS events, round(avg(CASE WHEN positive_steps > 0 THEN 1.0 ELSE 0.0 END), 6) AS pod_point, round(avg(CASE WHEN positive_steps_3x3 > 0 THEN 1.0 ELSE 0.0 END), 6) AS pod_3x3,
 round(avg(grid_mm - event_accum_mm), 6) AS bias_mm, round(avg(abs(grid_mm - event_accum_mm)), 6) AS mae_mm, round(sqrt(avg(pow(grid_mm - event_accum_mm, 2))), 6) AS rmse_mm, round(median(grid_mm / event_accum_mm), 6) AS median_ratio, round(avg(grid_mm / event_accum_mm), 6) AS mean_ratio,
 round(median(grid3x3_mm / event_accum_mm), 6) AS median_ratio_3x3, round(median(grid_mm / event_accum_mm) FILTER (WHERE positive_steps > 0), 6) AS median_ratio_hits, round(100 * avg(CASE WHEN grid_mm < event_accum_mm THEN 1.0 ELSE 0.0 END), 6) AS underestimate_pct, round(100 * avg(CASE WHEN grid_mm = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct"""


@query(sql(MATCHED, f"SELECT 'all' AS scope, {_SKILL} FROM matched UNION ALL SELECT CAST(window_min AS VARCHAR), {_SKILL} FROM matched GROUP BY window_min"))
def common_period_skill(spark: SparkSession, sf: str) -> DataFrame:
    return verify.skill(matched(spark, sf))


@query(sql(REF, "SELECT * FROM ref"))
def reference_windows(spark: SparkSession, sf: str) -> DataFrame:
    return win_ops.reference_windows(win_ops.half_hour_bins(iv(spark, sf)))


SAT = REF + ",\n" + CELL + GRID + """,
ps AS (SELECT station_id, step, max(rate) FILTER (WHERE di = 0 AND dj = 0) AS point, max(rate) AS best FROM nine JOIN grid USING (lon_idx, lat_idx) GROUP BY ALL),
sat AS (SELECT r.station_id, r.step * 30 + 30 AS ref_end, window_min, round(sum(b.point) / 2, 6) AS point_mm, round(sum(b.best) / 2, 6) AS best_mm, count(b.point) * 30 >= window_min * 0.95::DOUBLE AS sat_strict
  FROM ps r CROSS JOIN ws2 JOIN ps b ON b.station_id = r.station_id AND b.step > r.step - window_min // 30 AND b.step <= r.step GROUP BY r.station_id, r.step, window_min),
wq AS (SELECT station_id, window_min, round(quantile_cont(point_mm, 0.995) FILTER (WHERE sat_strict AND point_mm > 0), 6) AS q_point, round(quantile_cont(best_mm, 0.995) FILTER (WHERE sat_strict AND best_mm > 0), 6) AS q_best FROM sat GROUP BY ALL)"""


@query(sql(SAT, "SELECT * FROM sat"))
def satellite_windows(spark: SparkSession, sf: str) -> DataFrame:
    return verify.satellite_windows(grid(spark, sf), cells(spark, sf))


@query(sql(SAT, "SELECT * FROM wq"))
def wet_quantile_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return verify.wet_quantiles(verify.satellite_windows(grid(spark, sf), cells(spark, sf)))


# gauge thresholds of the regular timeline: the quantile of wet strict windows
GT = """,
gt AS (SELECT station_id, window_min, round(quantile_cont(accum_mm, 0.9) FILTER (WHERE strict AND accum_mm > 0), 6) AS threshold_mm FROM ref GROUP BY ALL)"""
CONF = SAT + GT + """,
cf AS (SELECT r.station_id, r.window_min, r.ref_end // 1440 AS day, r.ref_end, accum_mm >= threshold_mm AS a, point_mm >= threshold_mm AS pf, best_mm >= threshold_mm AS bf, coalesce(point_mm >= q_point, false) AS pr, coalesce(best_mm >= q_best, false) AS br
  FROM ref r JOIN sat s USING (station_id, ref_end, window_min) JOIN gt USING (station_id, window_min) JOIN wq USING (station_id, window_min) WHERE strict AND sat_strict AND threshold_mm > 0),
c2 AS (SELECT station_id, window_min, day, ref_end, a, 'fixed' AS mode, pf AS p, bf AS b FROM cf UNION ALL SELECT station_id, window_min, day, ref_end, a, 'relative', pr, br FROM cf),
c3 AS (SELECT *, 'overlap' AS stride FROM c2 UNION ALL SELECT *, 'scale_stride' FROM c2 WHERE ref_end % window_min = 0)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {y} a AND {n} {c}) AS {p}_{k}" for p, c in (("point", "p"), ("best", "b")) for k, y, n in (("tp", "", ""), ("fp", "NOT", ""), ("fn", "", "NOT"), ("tn", "NOT", "NOT")))


def ref_and_thresholds(spark: SparkSession, sf: str, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    ref = cut(win_ops.reference_windows(win_ops.half_hour_bins(iv(spark, sf) if base is None else base)))
    return ref, ref.groupBy("station_id", "window_min").agg(F.round(F.percentile(F.when(F.col("strict") & (F.col("accum_mm") > 0), F.col("accum_mm")), 0.9), 6).alias("threshold_mm"))


def at_gauges(spark: SparkSession, sf: str, fields: DataFrame, ref: DataFrame) -> DataFrame:
    """Satellite windows at the stations that have readings."""
    return cut(verify.satellite_windows(fields, cells(spark, sf).join(ref.select("station_id").distinct(), "station_id", "left_semi")))


def confusion(spark: SparkSession, sf: str, keys: list[str], fields: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    base = shared(spark, sf) if base is None else base
    ref, gauge = ref_and_thresholds(spark, sf, base)
    return verify.window_confusion(ref, at_gauges(spark, sf, grid(spark, sf, base) if fields is None else fields, ref), gauge, keys)


@query(sql(CONF, f"SELECT station_id, window_min, mode, stride, {_COUNTS} FROM c3 GROUP BY ALL"))
def window_confusion_station(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(spark, sf, ["station_id", "window_min"])


def _scored(prefixes: tuple[str, ...]) -> list[tuple[str, str]]:
    return [kv for p in prefixes for kv in verify.scores(*[f"{p}_{x}" for x in ("tp", "fp", "fn", "tn")], prefix=f"{p}_").items()]


@query(sql(CONF, f", s AS (SELECT window_min, mode, stride, {_COUNTS} FROM c3 GROUP BY ALL) SELECT *, {', '.join(f'{e} AS {k}' for k, e in _scored(('point', 'best')))} FROM s"))
def window_confusion_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = confusion(spark, sf, ["window_min"])
    return rows.withColumns({k: F.expr(e) for k, e in _scored(("point", "best"))})


AREA = ",\n" + CELL + """,
ar AS (SELECT r.*, (c.lon_idx // 3) * 10000 + c.lat_idx // 3 AS area, threshold_mm FROM ref r JOIN cell c USING (station_id) JOIN gt USING (station_id, window_min) WHERE strict AND threshold_mm > 0),
md AS (SELECT area, ref_end, window_min, median(accum_mm) AS m, count(*) AS n FROM ar GROUP BY ALL),
lo AS (SELECT a.station_id, a.ref_end, a.window_min, median(b.accum_mm) AS m FROM ar a JOIN ar b ON a.area = b.area AND a.ref_end = b.ref_end AND a.window_min = b.window_min AND a.station_id <> b.station_id GROUP BY ALL)"""


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 3 x 3 grid cells, so that several gauges share one."""
    return cells(spark, sf).select("station_id", F.expr("(lon_idx div 3) * 10000 + lat_idx div 3").alias("area"))


@query(sql(REF + GT + AREA, "SELECT area, ref_end, window_min, round(m, 4) AS median_mm, n AS stations FROM md WHERE n >= 2"))
def cell_median(spark: SparkSession, sf: str) -> DataFrame:
    ref, gauge = ref_and_thresholds(spark, sf)
    rows = ref.filter("strict").join(areas(spark, sf), "station_id").join(gauge.filter("threshold_mm > 0"), ["station_id", "window_min"])
    return rows.groupBy("area", "ref_end", "window_min").agg(F.round(F.percentile("accum_mm", 0.5), 4).alias("median_mm"), F.count("*").alias("stations")).filter("stations >= 2")


@query(sql(REF + GT + AREA, "SELECT station_id, ref_end, window_min, round(m, 4) AS loo_median_mm FROM lo"))
def loo_cell_median(spark: SparkSession, sf: str) -> DataFrame:
    ref, gauge = ref_and_thresholds(spark, sf)
    rows = ref.filter("strict").join(areas(spark, sf), "station_id").join(gauge.filter("threshold_mm > 0"), ["station_id", "window_min"]).select("station_id", "area", "ref_end", "window_min", "accum_mm")
    rows = verify.group_medians(rows, ["area", "ref_end", "window_min"]).filter("stations >= 2")
    return rows.select("station_id", "ref_end", "window_min", F.round("loo_median", 4).alias("loo_median_mm"))


_SC = verify.scores()


@query(sql(REF + GT + AREA, f""", b AS (SELECT ar.*, 'all_cells' AS subset, md.m FROM ar JOIN md USING (area, ref_end, window_min) UNION ALL SELECT ar.*, 'multi_station_cells', md.m FROM ar JOIN md USING (area, ref_end, window_min) WHERE n >= 2
 UNION ALL SELECT ar.*, 'leave_one_out', lo.m FROM ar JOIN lo USING (station_id, ref_end, window_min)),
c AS (SELECT window_min, subset, count(*) FILTER (WHERE accum_mm >= threshold_mm AND m >= threshold_mm) AS tp, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND m >= threshold_mm) AS fp, count(*) FILTER (WHERE accum_mm >= threshold_mm AND NOT m >= threshold_mm) AS fn,
 count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND NOT m >= threshold_mm) AS tn, round(avg(m - accum_mm), 6) AS bias_mm, round(avg(abs(m - accum_mm)), 6) AS mae_mm FROM b GROUP BY ALL) SELECT *, {', '.join(f'{e} AS {k}' for k, e in _SC.items())} FROM c"""))
def areal_baseline(spark: SparkSession, sf: str) -> DataFrame:
    ref, gauge = ref_and_thresholds(spark, sf)
    return verify.areal_baseline(ref, areas(spark, sf), gauge).withColumns({k: F.expr(e) for k, e in _SC.items()})


@query()
def bootstrap_counts_ci(spark: SparkSession, sf: str) -> DataFrame:
    base = shared(spark, sf)
    fields = grid(spark, sf, base)
    daily = cut(confusion(spark, sf, ["window_min", "day"], fields, base))
    return verify.bootstrap_counts(daily, fields.select(F.expr("(step * 30 + 30) div 1440").alias("day")))


@query()
def bootstrap_events_ci(spark: SparkSession, sf: str) -> DataFrame:
    return verify.bootstrap_events(matched(spark, sf))


DISP = MATCHED + """,
er AS (SELECT *, round(mm, 6) AS mr, di * di + dj * dj AS d2 FROM ec),
et AS (SELECT *, max(mr) OVER (PARTITION BY station_id, window_min, end_min) AS top FROM er),
eb AS (SELECT *, CASE WHEN coalesce(top, 0) <= 0 THEN d2 = 0 ELSE coalesce(mr >= top - 1e-7, false) END AS cand FROM et),
dp AS (SELECT station_id, window_min, end_min, max(event_accum_mm) AS event_accum_mm, min((d2, di, dj)) FILTER (WHERE cand) AS b, round(coalesce(max(mr) FILTER (WHERE d2 = 0), 0), 6) AS point_mm, round(coalesce(max(mr), 0), 6) AS best_mm, count(*) FILTER (WHERE valid > 0) AS valid_cells FROM eb GROUP BY ALL),
disp AS (SELECT station_id, window_min, end_min, event_accum_mm, b[2] AS di, b[3] AS dj, point_mm, best_mm, valid_cells, b[1] = 0 AS same_cell, round(best_mm - point_mm, 6) AS gain_mm, round(CASE WHEN point_mm > 0 THEN best_mm / point_mm END, 6) AS gain_ratio, round(best_mm / event_accum_mm, 6) AS recovery_ratio, best_mm > point_mm AS improves FROM dp)"""


def displaced(spark: SparkSession, sf: str) -> DataFrame:
    base = shared(spark, sf)
    return verify.displacement(catalog(spark, sf, base), cells(spark, sf), grid(spark, sf, base))


@query(sql(DISP, "SELECT * FROM disp"))
def displacement(spark: SparkSession, sf: str) -> DataFrame:
    return displaced(spark, sf)


_DS = "count(*) AS events, round(median(gain_mm), 6) AS median_gain_mm, round(avg(CASE WHEN same_cell THEN 1.0 ELSE 0.0 END), 6) AS same_share, round(avg(CASE WHEN gain_mm > 0 THEN 1.0 ELSE 0.0 END), 6) AS gain_share, round(sum(point_mm), 4) AS point_sum_mm, round(sum(best_mm), 4) AS best_sum_mm"


@query(sql(DISP, f"SELECT 'all' AS scope, {_DS} FROM disp UNION ALL SELECT CAST(window_min AS VARCHAR), {_DS} FROM disp GROUP BY window_min"))
def displacement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT coalesce(CAST(window_min AS STRING), 'all') AS scope, {_DS.replace('1.0', '1.0D').replace('0.0', '0.0D')} FROM {{d}} GROUP BY GROUPING SETS ((), (window_min))", d=displaced(spark, sf))


@query(sql(DISP, "SELECT window_min, round(avg(CASE WHEN di = 0 AND dj = 0 THEN 1.0 ELSE 0.0 END), 6) AS same, round(avg(CASE WHEN abs(di) + abs(dj) = 1 THEN 1.0 ELSE 0.0 END), 6) AS axis, round(avg(CASE WHEN abs(di) + abs(dj) = 2 THEN 1.0 ELSE 0.0 END), 6) AS diagonal FROM disp GROUP BY window_min"))
def displacement_profile(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.expr(f"CASE WHEN {c} THEN 1.0D ELSE 0.0D END")), 6)
    return displaced(spark, sf).groupBy("window_min").agg(share("di = 0 AND dj = 0").alias("same"), share("abs(di) + abs(dj) = 1").alias("axis"), share("abs(di) + abs(dj) = 2").alias("diagonal"))


# ---------------------------------------------------------------- policy, strata, cases

POL = AUD + """,
ps_ AS (SELECT station_id FROM (SELECT station_id, window_min, end_min, max(coalesce(neighbour_accum_mm, 0)) AS m FROM au GROUP BY ALL) GROUP BY station_id HAVING count(*) >= 2 AND max(m) <= 0),
pol AS (SELECT station_id, window_min, end_min, max(coalesce(neighbour_accum_mm, 0)) AS max_neighbour_mm, station_id IN (SELECT station_id FROM ps_) AS excluded FROM au GROUP BY ALL)"""


def policy(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Audited events with the decision: stations with two or more audited events and never any rain at a neighbour are excluded."""
    per = cut(audited(spark, sf, base)).groupBy("station_id", "window_min", "end_min").agg(F.max(F.coalesce("neighbour_accum_mm", F.lit(0.0))).alias("max_neighbour_mm"))
    out = per.groupBy("station_id").agg(F.count("*").alias("n"), F.max("max_neighbour_mm").alias("m")).filter("n >= 2 AND m <= 0").select("station_id", F.lit(True).alias("x"))
    return per.join(out, "station_id", "left").select("station_id", "window_min", "end_min", "max_neighbour_mm", F.coalesce("x", F.lit(False)).alias("excluded"))


@query(sql(POL, "SELECT * FROM pol"))
def outlier_policy(spark: SparkSession, sf: str) -> DataFrame:
    return policy(spark, sf)


@query(sql(POL + MATCHED.removeprefix(EV).replace(ST + ",\n", "", 1), """, b AS (SELECT 'baseline' AS scenario, * FROM matched UNION ALL SELECT 'filtered', * FROM matched WHERE (station_id, window_min, end_min) NOT IN (SELECT (station_id, window_min, end_min) FROM pol WHERE excluded))
SELECT scenario, window_min, count(*) AS events, round(avg(grid_mm - event_accum_mm), 6) AS bias_mm, round(median(grid_mm / event_accum_mm), 6) AS median_ratio FROM b GROUP BY ALL"""))
def policy_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    base = shared(spark, sf)
    m = matched(spark, sf, base)
    kept = m.join(policy(spark, sf, base).filter("excluded"), ["station_id", "window_min", "end_min"], "left_anti")
    both = m.withColumn("scenario", F.lit("baseline")).unionByName(kept.withColumn("scenario", F.lit("filtered")))
    return both.groupBy("scenario", "window_min").agg(F.count("*").alias("events"), F.round(F.avg(F.expr("grid_mm - event_accum_mm")), 6).alias("bias_mm"), F.round(F.percentile(F.expr("grid_mm / event_accum_mm"), 0.5), 6).alias("median_ratio"))


KX, KY = (f"{x!r}::DOUBLE" for x in (spatial.KM_PER_DEGREE * math.cos(math.radians(39.5)), spatial.KM_PER_DEGREE))
COAST = f"""cv AS (SELECT lat_idx, max(lon) * {KX} AS x, min(lat) * {KY} AS y FROM cv_imerg_grid_cells WHERE inside_cv_polygon GROUP BY lat_idx),
sg AS (SELECT x, y, lead(x) OVER (ORDER BY lat_idx) - x AS dx, lead(y) OVER (ORDER BY lat_idx) - y AS dy FROM cv),
pt AS (SELECT station_id, alt, lon * {KX} AS px, lat * {KY} AS py FROM avamet_station_inventory_cv),
pd AS (SELECT *, greatest(0, least(1, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy))) AS t FROM pt LEFT JOIN sg ON dx IS NOT NULL),
altitude AS (SELECT station_id, round(min(sqrt(pow(px - x - t * dx, 2) + pow(py - y - t * dy, 2))), 6) AS coast_km, CASE WHEN alt IS NULL THEN 'Unknown' WHEN alt <= 200 THEN 'Low' WHEN alt <= 800 THEN 'Mid' ELSE 'High' END AS altitude_group,
  CASE WHEN min(sqrt(pow(px - x - t * dx, 2) + pow(py - y - t * dy, 2))) <= 25 THEN 'Coastal' ELSE 'Interior' END AS coast_group FROM pd GROUP BY station_id, alt)"""


@query(sql(COAST, "SELECT * FROM altitude"))
def strata(spark: SparkSession, sf: str) -> DataFrame:
    return _strata(spark, sf)


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    altitude = F.when(F.col("alt").isNull(), "Unknown").when(F.col("alt") <= 200, "Low").when(F.col("alt") <= 800, "Mid").otherwise("High")
    km = spatial.distance_to_line_km("lat", "lon", spatial.border_segments(table(spark, sf, "cv_imerg_grid_cells")))
    rows = table(spark, sf, "avamet_station_inventory_cv").withColumn("coast_km", km)
    return rows.select("station_id", F.round("coast_km", 6).alias("coast_km"), altitude.alias("altitude_group"), F.when(F.col("coast_km") <= 25, "Coastal").otherwise("Interior").alias("coast_group"))


_STRATA_SQL = COAST + """,
sm AS (SELECT m.*, altitude_group, coast_group, CASE WHEN month(make_timestamp(end_min * 60000000)) IN (9, 10, 11) THEN 'SON' ELSE 'Rest' END AS season FROM matched m JOIN altitude USING (station_id)),
sf AS (SELECT 'all' AS family, 'all' AS stratum, * FROM sm UNION ALL SELECT 'season', season, * FROM sm UNION ALL SELECT 'coast', coast_group, * FROM sm UNION ALL SELECT 'altitude', altitude_group, * FROM sm)"""


@query(sql(MATCHED, f", {_STRATA_SQL} SELECT family, stratum, 'all' AS scale, count(*) AS events, round(median(grid3x3_mm / event_accum_mm), 6) AS median_ratio_3x3 FROM sf GROUP BY ALL UNION ALL SELECT family, stratum, CAST(window_min AS VARCHAR), count(*), round(median(grid3x3_mm / event_accum_mm), 6) FROM sf GROUP BY family, stratum, window_min"))
def stratified_skill(spark: SparkSession, sf: str) -> DataFrame:
    m = matched(spark, sf).join(_strata(spark, sf), "station_id").withColumn("season", F.when(F.month(F.timestamp_seconds(F.col("end_min") * 60)).isin(9, 10, 11), "SON").otherwise("Rest"))
    kind = lambda f, c: F.struct(F.lit(f).alias("family"), c.alias("stratum"))
    rows = m.select("window_min", (F.col("grid3x3_mm") / F.col("event_accum_mm")).alias("r"), F.inline(F.array(kind("all", F.lit("all")), kind("season", F.col("season")), kind("coast", F.col("coast_group")), kind("altitude", F.col("altitude_group")))))
    return spark.sql("SELECT family, stratum, coalesce(CAST(window_min AS STRING), 'all') AS scale, count(*) AS events, round(percentile(r, 0.5D), 6) AS median_ratio_3x3 FROM {r} GROUP BY GROUPING SETS ((family, stratum), (family, stratum, window_min))", r=rows)


CASE = MATCHED + """,
cd AS (SELECT end_min // 1440 AS day, count(*) AS event_count, count(DISTINCT station_id) AS station_count, round(sum(event_accum_mm), 4) AS gauge_sum_mm, max(event_accum_mm) AS gauge_max_mm, round(sum(grid_mm), 4) AS grid_sum_mm FROM matched WHERE window_min = 360 AND month(make_timestamp(end_min * 60000000)) IN (9, 10, 11) GROUP BY ALL)"""


@query(sql(CASE, "SELECT * FROM cd ORDER BY station_count DESC, gauge_sum_mm DESC, event_count DESC, day LIMIT 2"))
def case_days(spark: SparkSession, sf: str) -> DataFrame:
    """The two autumn days with most stations in six-hour events (a top-2 report)."""
    rows = matched(spark, sf).filter("window_min = 360").filter(F.month(F.timestamp_seconds(F.col("end_min") * 60)).isin(9, 10, 11))
    days = rows.groupBy(F.expr("end_min div 1440").alias("day")).agg(F.count("*").alias("event_count"), F.count_distinct("station_id").alias("station_count"), F.round(F.sum("event_accum_mm"), 4).alias("gauge_sum_mm"), F.max("event_accum_mm").alias("gauge_max_mm"), F.round(F.sum("grid_mm"), 4).alias("grid_sum_mm"))
    return days.orderBy(F.col("station_count").desc(), F.col("gauge_sum_mm").desc(), F.col("event_count").desc(), "day").limit(2)


DAY = BIN + """,
dg AS (SELECT station_id, bin // 48 AS day, round(sum(mass), 6) AS mm, round(sum(minutes) / 1440, 6) AS coverage FROM bn GROUP BY ALL)"""


def gauge_days(spark: SparkSession, sf: str) -> DataFrame:
    bins = win_ops.half_hour_bins(iv(spark, sf))
    return bins.groupBy("station_id", F.expr("bin div 48").alias("day")).agg(F.round(F.sum("mass"), 6).alias("mm"), F.round(F.sum("minutes") / 1440, 6).alias("coverage"))


@query(sql(DAY, "SELECT * FROM dg"))
def daily_gauge(spark: SparkSession, sf: str) -> DataFrame:
    return gauge_days(spark, sf)


DAYS = DAY + ",\n" + CELL + GRID + """,
gd AS (SELECT lon_idx, lat_idx, step // 48 AS day, round(sum(rate) * 0.5::DOUBLE, 6) AS mm FROM grid GROUP BY ALL)"""


def grid_days(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).groupBy("lon_idx", "lat_idx", F.expr("step div 48").alias("day")).agg(F.round(F.sum("rate") * 0.5, 6).alias("mm"))


@query(sql(DAYS, "SELECT * FROM gd"))
def daily_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_days(spark, sf)


@query(sql(DAYS, """, cm AS (SELECT c.lon_idx, c.lat_idx, day, median(mm) AS gauge_mm FROM dg JOIN cell c USING (station_id) GROUP BY ALL)
SELECT day, count(*) AS n_cells, round(median(g.mm - gauge_mm), 6) AS median_diff_mm, round(avg(g.mm - gauge_mm), 5) AS mean_diff_mm, round(max(abs(g.mm - gauge_mm)), 6) AS max_abs_diff_mm FROM cm JOIN gd g USING (lon_idx, lat_idx, day) GROUP BY day"""))
def daily_difference(spark: SparkSession, sf: str) -> DataFrame:
    med = gauge_days(spark, sf).join(cells(spark, sf), "station_id").groupBy("lon_idx", "lat_idx", "day").agg(F.percentile("mm", 0.5).alias("gauge_mm"))
    d = F.col("mm") - F.col("gauge_mm")
    return grid_days(spark, sf).join(med, ["lon_idx", "lat_idx", "day"]).groupBy("day").agg(F.count("*").alias("n_cells"), F.round(F.percentile(d, 0.5), 6).alias("median_diff_mm"), F.round(F.avg(d), 5).alias("mean_diff_mm"), F.round(F.max(F.abs(d)), 6).alias("max_abs_diff_mm"))


@query(sql(MATCHED, "SELECT end_min // 1440 AS day, window_min, count(*) AS events, count(DISTINCT station_id) AS stations, round(sum(event_accum_mm), 4) AS gauge_sum_mm, round(median(event_accum_mm), 6) AS gauge_median_mm, round(sum(grid_mm), 4) AS grid_sum_mm FROM matched GROUP BY ALL"))
def episode_window(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).groupBy(F.expr("end_min div 1440").alias("day"), "window_min").agg(F.count("*").alias("events"), F.count_distinct("station_id").alias("stations"), F.round(F.sum("event_accum_mm"), 4).alias("gauge_sum_mm"), F.round(F.percentile("event_accum_mm", 0.5), 6).alias("gauge_median_mm"), F.round(F.sum("grid_mm"), 4).alias("grid_sum_mm"))


@query(sql(MATCHED, "SELECT day, station_id, end_min, event_accum_mm, grid_mm, grid3x3_mm FROM (SELECT *, end_min // 1440 AS day, row_number() OVER (PARTITION BY end_min // 1440 ORDER BY event_accum_mm DESC, end_min, station_id DESC) AS k FROM matched WHERE window_min = 360) WHERE k = 1"))
def episode_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The largest six-hour event of each day; earlier ones first on ties."""
    best = F.max_by(F.struct("station_id", "end_min", "event_accum_mm", "grid_mm", "grid3x3_mm"), F.struct("event_accum_mm", -F.col("end_min"), "station_id"))
    return matched(spark, sf).filter("window_min = 360").groupBy(F.expr("end_min div 1440").alias("day")).agg(best.alias("b")).select("day", "b.*")


# ---------------------------------------------------------------- figure tables


@query(sql(CONF, f", s AS (SELECT window_min, mode, {_COUNTS} FROM c3 WHERE stride = 'scale_stride' GROUP BY ALL) SELECT window_min, mode, {', '.join(f'{e} AS {k}' for k, e in _scored(('point', 'best')) if k.split('_')[1] in ('pod', 'far', 'csi', 'ets'))} FROM s"))
def fig_multiscale_skill(spark: SparkSession, sf: str) -> DataFrame:
    rows = confusion(spark, sf, ["window_min"]).filter("stride = 'scale_stride'")
    return rows.select("window_min", "mode", *[F.expr(e).alias(k) for k, e in _scored(("point", "best")) if k.split("_")[1] in ("pod", "far", "csi", "ets")])


@query(sql(CONF + AREA, f""", s AS (SELECT window_min, {_COUNTS} FROM c3 WHERE stride = 'scale_stride' AND mode = 'fixed' GROUP BY ALL),
l AS (SELECT window_min, count(*) FILTER (WHERE accum_mm >= threshold_mm AND lo.m >= threshold_mm) AS tp, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND lo.m >= threshold_mm) AS fp, count(*) FILTER (WHERE accum_mm >= threshold_mm AND NOT lo.m >= threshold_mm) AS fn, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND NOT lo.m >= threshold_mm) AS tn FROM ar JOIN lo USING (station_id, ref_end, window_min) GROUP BY ALL)
SELECT s.window_min, {verify.scores('point_tp', 'point_fp', 'point_fn', 'point_tn')['ets']} AS ets_point, {verify.scores('best_tp', 'best_fp', 'best_fn', 'best_tn')['ets']} AS ets_best, {_SC['ets']} AS ets_leave_one_out FROM s LEFT JOIN l USING (window_min)""".replace(CELL + ",", "", 0)))
def fig_ets_curves(spark: SparkSession, sf: str) -> DataFrame:
    base = shared(spark, sf)
    ref, gauge = ref_and_thresholds(spark, sf, base)
    sat = at_gauges(spark, sf, grid(spark, sf, base), ref)
    s = verify.window_confusion(ref, sat, gauge, ["window_min"]).filter("stride = 'scale_stride' AND mode = 'fixed'")
    s = s.select("window_min", F.expr(verify.scores("point_tp", "point_fp", "point_fn", "point_tn")["ets"]).alias("ets_point"), F.expr(verify.scores("best_tp", "best_fp", "best_fn", "best_tn")["ets"]).alias("ets_best"))
    loo = verify.areal_baseline(ref, areas(spark, sf), gauge).filter("subset = 'leave_one_out'").select("window_min", F.expr(_SC["ets"]).alias("ets_leave_one_out"))
    return s.join(loo, "window_min", "left")


ORACLES["fig_ets_curves"] = ORACLES["fig_ets_curves"].replace(AREA, AREA.replace(",\n" + CELL, ""))


# ---------------------------------------------------------------- full metrics of displacement, strata and policy


def measured(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Matched events and displacements with distance, from one catalogue and grid."""
    base = shared(spark, sf)
    events, where, fields = catalog(spark, sf, base), cells(spark, sf), grid(spark, sf, base)
    moved = verify.with_distance(verify.displacement(events, where, fields), where, table(spark, sf, "cv_imerg_grid_cells"))
    return cut(verify.event_match(events, where, fields)), cut(moved)


def _case_days(m: DataFrame) -> DataFrame:
    rows = m.filter("window_min = 360").filter(F.month(F.timestamp_seconds(F.col("end_min") * 60)).isin(9, 10, 11))
    days = rows.groupBy(F.expr("end_min div 1440").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("s"), F.round(F.sum("event_accum_mm"), 4).alias("mm"))
    return days.orderBy(F.col("s").desc(), F.col("mm").desc(), F.col("n").desc(), "day").limit(2)


@query()
def displacement_distance(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf)[1]


@query()
def displacement_statistics(spark: SparkSession, sf: str) -> DataFrame:
    m, moved = measured(spark, sf)
    return verify.displacement_statistics(moved, _case_days(m))


@query()
def stratified_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics of every stratum; the given stations have no province."""
    m, moved = measured(spark, sf)
    m = m.join(moved.select("station_id", "window_min", "end_min", "distance_km"), ["station_id", "window_min", "end_min"], "left").join(_strata(spark, sf), "station_id")
    season = F.when(F.month(F.timestamp_seconds(F.col("end_min") * 60)).isin(9, 10, 11), "SON").otherwise("Rest")
    kind = lambda f, c: F.struct(F.lit(f).alias("family"), c.alias("stratum"))
    rows = m.select("*", F.inline(F.array(kind("all", F.lit("all")), kind("season", season), kind("coast", F.col("coast_group")), kind("altitude", F.col("altitude_group")))))
    return verify.event_metrics(rows, ["family", "stratum", "coalesce(CAST(window_min AS STRING), 'all') AS scale"], "((family, stratum), (family, stratum, window_min))")


@query()
def policy_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Skill before and after the policy, and the filtered minus the baseline value of each metric."""
    base = shared(spark, sf)
    m = matched(spark, sf, base)
    kept = m.join(policy(spark, sf, base).filter("excluded"), ["station_id", "window_min", "end_min"], "left_anti")
    both = m.withColumn("scenario", F.lit("baseline")).unionByName(kept.withColumn("scenario", F.lit("filtered")))
    return policy_rows(both)


def policy_rows(both: DataFrame) -> DataFrame:
    s = cut(verify.event_metrics(both, ["scenario", "coalesce(CAST(window_min AS STRING), 'all') AS scope"], "((scenario), (scenario, window_min))"))
    names = [c for c in s.columns if c not in ("scenario", "scope")]
    delta = s.filter("scenario = 'baseline'").alias("b").join(s.filter("scenario = 'filtered'").alias("f"), "scope")
    whole = lambda c: F.col(f"f.{c}") - F.col(f"b.{c}")
    return s.unionByName(delta.select(F.lit("delta").alias("scenario"), "scope", *[(whole(c) if c in ("events", "stations") else F.round(whole(c), 6)).alias(c) for c in names]))


@query()
def fig_event_pod(spark: SparkSession, sf: str) -> DataFrame:
    """The event detection rates of the multiscale figure with their intervals."""
    return bootstrap_events_ci(spark, sf).filter("metric IN ('pod_point', 'pod_3x3')")


@query()
def fig_displacement(spark: SparkSession, sf: str) -> DataFrame:
    return displacement_statistics(spark, sf).filter("scope <> 'all'").select("scope", "day", "window_min", "events", "median_distance_km", "p90_distance_km", "fraction_same_cell", "fraction_displaced", "fraction_gain_positive", "median_gain_mm", "median_point_recovery_ratio", "median_3x3_recovery_ratio")


@query()
def fig_stratification(spark: SparkSession, sf: str) -> DataFrame:
    """Seasons and coast over all four windows, NULL where a stratum has no event."""
    s = cut(stratified_skill(spark, sf).filter("family IN ('season', 'coast')"))
    scales = spark.createDataFrame([(str(w),) for w in win_ops.WINDOWS], "scale string")
    return s.select("family", "stratum").distinct().crossJoin(scales).join(s, ["family", "stratum", "scale"], "left")


# ---------------------------------------------------------------- baseline per grid cell


def single_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each station's own grid cell as its area."""
    return cells(spark, sf).select("station_id", F.struct("lon_idx", "lat_idx").alias("area"))


@query()
def cell_medians_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Per station, half-hour end and window: the median of its grid cell and of the other stations there."""
    ref, gauge = ref_and_thresholds(spark, sf)
    rows = ref.filter("strict").join(single_cells(spark, sf), "station_id").join(gauge.filter("threshold_mm > 0"), ["station_id", "window_min"])
    rows = verify.group_medians(rows.select("station_id", "area", "ref_end", "window_min", "accum_mm"), ["area", "ref_end", "window_min"])
    return rows.select("station_id", "area.*", "ref_end", "window_min", "stations", F.round("area_median", 4).alias("median_mm"), F.round("loo_median", 4).alias("loo_median_mm"))


@query()
def areal_baseline_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    ref, gauge = ref_and_thresholds(spark, sf)
    return verify.areal_baseline(ref, single_cells(spark, sf), gauge).withColumns({k: F.expr(e) for k, e in _SC.items()})


@query()
def fig_ets_four_curves(spark: SparkSession, sf: str) -> DataFrame:
    s = window_confusion_scale(spark, sf).filter("stride = 'scale_stride' AND mode = 'fixed'").select("window_min", F.col("point_ets").alias("ets_point"), F.col("best_ets").alias("ets_best"))
    b = cut(areal_baseline_by_cell(spark, sf))
    for subset in ("multi_station_cells", "leave_one_out"):
        s = s.join(b.filter(F.col("subset") == subset).select("window_min", F.col("ets").alias(f"ets_{subset}")), "window_min", "left")
    return s
