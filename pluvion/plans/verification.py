"""Further queries of the verification (full metrics, summaries, strict modes), and SQL for those that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvion.functions import scalars
from pluvion.operators import events as ev
from pluvion.operators import near, spatial, verify
from pluvion.operators import windows as win_ops
from pluvion.plans import reference as ref
from pluvion.plans.reference import sql
from pluvion.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return keep


def n(c: str):
    return F.sum(F.expr(f"CAST(({c}) AS BIGINT)"))


def pct(c: str):
    return F.round(100 * F.avg(F.expr(f"CASE WHEN {c} THEN 1.0D ELSE 0.0D END")), 6)


def q(c, p: float):
    return F.round(F.percentile(c, p), 6)


# ---------------------------------------------------------------- completeness

_COMP = """count(*) AS n_windows, count(*) FILTER (WHERE complete_strict) AS n_strict, count(*) FILTER (WHERE complete_loose) AS n_loose, count(*) FILTER (WHERE fail_count > 0) AS n_with_fail, count(*) FILTER (WHERE suspect_count > 0) AS n_with_suspect,
 round(quantile_cont(coverage_ratio, 0.5), 6) AS median_coverage, round(quantile_cont(coverage_ratio, 0.95), 6) AS p95_coverage, round(quantile_cont(accum_mm, 0.99) FILTER (WHERE complete_strict), 6) AS p99_mm_strict, max(accum_mm) FILTER (WHERE complete_strict) AS max_mm_strict"""
COMP = ref.WIN + f""",
comp AS (SELECT station_id, window_min, {_COMP} FROM win GROUP BY station_id, window_min)"""


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    strict = F.when(F.col("complete_strict"), F.col("accum_mm"))
    return ref.win(spark, sf).groupBy("station_id", "window_min").agg(
        F.count("*").alias("n_windows"), n("complete_strict").alias("n_strict"), n("complete_loose").alias("n_loose"), n("fail_count > 0").alias("n_with_fail"), n("suspect_count > 0").alias("n_with_suspect"),
        q("coverage_ratio", 0.5).alias("median_coverage"), q("coverage_ratio", 0.95).alias("p95_coverage"), q(strict, 0.99).alias("p99_mm_strict"), F.max(strict).alias("max_mm_strict"),
    )


@query(sql(COMP, "SELECT * FROM comp"))
def completeness_station(spark: SparkSession, sf: str) -> DataFrame:
    return completeness(spark, sf)


_WIDE = ("n_strict", "n_loose", "median_coverage", "p99_mm_strict", "max_mm_strict")


@query(sql(COMP, "SELECT station_id, " + ", ".join(f"max({c}) FILTER (WHERE window_min = {w}) AS w{w}_{c}" for w in win_ops.WINDOWS for c in _WIDE) + " FROM comp GROUP BY station_id"))
def completeness_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row a station, the windows side by side."""
    return completeness(spark, sf).groupBy("station_id").agg(*[F.max(F.when(F.col("window_min") == w, F.col(c))).alias(f"w{w}_{c}") for w in win_ops.WINDOWS for c in _WIDE])


@query(sql(COMP, """SELECT window_min, count(*) AS n_stations, CAST(sum(n_windows) AS BIGINT) AS n_windows, CAST(sum(n_strict) AS BIGINT) AS n_strict, CAST(sum(n_loose) AS BIGINT) AS n_loose, CAST(sum(n_with_fail) AS BIGINT) AS n_with_fail, CAST(sum(n_with_suspect) AS BIGINT) AS n_with_suspect,
 round(median(median_coverage), 6) AS median_of_medians, round(median(p95_coverage), 6) AS median_of_p95 FROM comp GROUP BY window_min"""))
def completeness_scale(spark: SparkSession, sf: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_windows", "n_strict", "n_loose", "n_with_fail", "n_with_suspect")]
    return completeness(spark, sf).groupBy("window_min").agg(F.count("*").alias("n_stations"), *sums, q("median_coverage", 0.5).alias("median_of_medians"), q("p95_coverage", 0.5).alias("median_of_p95"))


# ---------------------------------------------------------------- catalogue

_STRICT = lambda text: text.replace("count(*) FILTER (WHERE complete_loose) AS n_complete_used, count(*) FILTER (WHERE complete_loose AND", "count(*) FILTER (WHERE complete_strict) AS n_complete_used, count(*) FILTER (WHERE complete_strict AND").replace("quantile_cont(accum_mm, 0.995) FILTER (WHERE complete_loose", "quantile_cont(accum_mm, 0.995) FILTER (WHERE complete_strict").replace("WHERE complete_loose AND accum_mm > 0 AND accum_mm >= threshold_mm", "WHERE complete_strict AND accum_mm > 0 AND accum_mm >= threshold_mm")


@query(sql(_STRICT(ref.EV), "SELECT * FROM ev"))
def event_catalog_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Events of strictly complete windows only."""
    return ref.catalog(spark, sf, mode="strict")


_SUPPORT = """count(*) AS n_events, round(100 * avg(CASE WHEN suspect_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS suspect_pct, round(100 * avg(CASE WHEN neighbour_supporting > 0 THEN 1.0 ELSE 0.0 END), 6) AS supported_pct, round(100 * avg(CASE WHEN neighbour_supporting > 0 AND suspect_count = 0 THEN 1.0 ELSE 0.0 END), 6) AS supported_clean_pct,
 round(CAST(quantile_cont(neighbour_supporting, 0.5) AS DOUBLE), 6) AS median_supporting, round(quantile_cont(event_rate_mmh, 0.5), 6) AS median_rate_mmh, round(quantile_cont(event_rate_mmh, 0.9), 6) AS p90_rate_mmh"""


@query(sql(ref.SUP, f""", per AS (SELECT t.station_id, t.window_min, count(e.end_min) AS k FROM thr t LEFT JOIN ev e USING (station_id, window_min) GROUP BY ALL),
ps AS (SELECT window_min, count(*) AS n_station_rows, {', '.join(f'round(CAST(quantile_cont(k, 0.{p}) AS DOUBLE), 6) AS p{p}0_events' for p in (1, 5, 9))} FROM per GROUP BY window_min),
es AS (SELECT window_min, {_SUPPORT} FROM sp JOIN (SELECT station_id, window_min, end_min, suspect_count, event_rate_mmh FROM ev) USING (station_id, window_min, end_min) GROUP BY window_min)
SELECT * FROM ps LEFT JOIN es USING (window_min)"""))
def support_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Events per station (percentiles, stations without any included), support and suspect shares, rates, per window."""
    base = ref.shared(spark, sf)
    w = cut(ref.win(spark, sf, base))
    thr = cut(ev.pot_thresholds(w))
    events = cut(ev.event_catalog(w, thr))
    beside = spatial.radius_neighbours(ref.stations(spark, sf)).select("station_id", "neighbour_id", "distance_km")
    keys = ["station_id", "window_min", "end_min"]
    es = ev.neighbour_support(events, beside, base).join(events.select(*keys, "suspect_count", "event_rate_mmh"), keys).groupBy("window_min").agg(
        F.count("*").alias("n_events"), pct("suspect_count > 0").alias("suspect_pct"), pct("neighbour_support").alias("supported_pct"), pct("neighbour_support AND suspect_count = 0").alias("supported_clean_pct"),
        q("neighbour_supporting", 0.5).alias("median_supporting"), q("event_rate_mmh", 0.5).alias("median_rate_mmh"), q("event_rate_mmh", 0.9).alias("p90_rate_mmh"),
    )
    per = thr.select("station_id", "window_min").join(events.groupBy("station_id", "window_min").agg(F.count("*").alias("k")), ["station_id", "window_min"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return per.groupBy("window_min").agg(F.count("*").alias("n_station_rows"), *[q("k", p / 10).alias(f"p{p}0_events") for p in (1, 5, 9)]).join(es, "window_min", "left")


@query(sql(ref.AUD, "SELECT au.*, round(neighbour_accum_mm * 60 / window_min, 6) AS neighbour_rate_mmh, coalesce(neighbour_accum_mm > 0, false) AS positive_signal, e.coverage_ratio, e.cluster_size, e.window_rank_ratio FROM au JOIN (SELECT station_id, window_min, end_min, coverage_ratio, cluster_size, window_rank_ratio FROM ev) e USING (station_id, window_min, end_min)"))
def audit_details(spark: SparkSession, sf: str) -> DataFrame:
    """Audited events with the neighbours' rates and signals and the event's own fields."""
    base = ref.shared(spark, sf)
    events = ref.catalog(spark, sf, base).select("station_id", "window_min", "end_min", "coverage_ratio", "cluster_size", "window_rank_ratio")
    keys = ["station_id", "window_min", "end_min"]
    rows = ref.audited(spark, sf, base).withColumns({"neighbour_rate_mmh": F.round(F.col("neighbour_accum_mm") * 60 / F.col("window_min"), 6), "positive_signal": F.coalesce(F.col("neighbour_accum_mm") > 0, F.lit(False))})
    return rows.join(events, keys)


@query(sql(ref.EV, "SELECT concat_ws('|', station_id, CAST(window_min AS VARCHAR), strftime(make_timestamp(end_min * 60000000), '%Y-%m-%dT%H:%M:%S')) AS event_key, CASE WHEN window_min < 60 THEN window_min || ' min' ELSE (window_min // 60) || ' h' END AS scale, round(least(1, greatest(0, coverage_ratio)), 6) AS coverage, round(CASE WHEN threshold_mm > 0 THEN event_accum_mm / threshold_mm END, 6) AS ratio FROM ev"))
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Text keys and labels of the events, with a clipped share and a guarded ratio."""
    ratio = scalars.safe_ratio(F.col("event_accum_mm"), F.col("threshold_mm"))
    return ref.catalog(spark, sf).select(scalars.event_key("station_id", "window_min", "end_min").alias("event_key"), scalars.scale_label("window_min").alias("scale"), F.round(scalars.clip01(F.col("coverage_ratio")), 6).alias("coverage"), F.round(ratio, 6).alias("ratio"))


# ---------------------------------------------------------------- cells, matches, skill


@query(sql(ref.CELL, """SELECT station_id, lon_idx, lat_idx, NOT coalesce(c.inside_cv_polygon, false) AS fallback FROM cell LEFT JOIN cv_imerg_grid_cells c USING (lon_idx, lat_idx)"""))
def cell_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each station's cell, and whether it lies outside the region, so that the nearest cell inside would stand in."""
    inside = table(spark, sf, "cv_imerg_grid_cells").select("lon_idx", "lat_idx", "inside_cv_polygon")
    rows = ref.cells(spark, sf).join(inside, ["lon_idx", "lat_idx"], "left")
    return rows.select("station_id", "lon_idx", "lat_idx", (~F.coalesce("inside_cv_polygon", F.lit(False))).alias("fallback"))


@query(sql(ref.MATCHED, ", pk3 AS (SELECT station_id, window_min, end_min, max(peak) AS grid3x3_peak_mmh FROM ec GROUP BY ALL) SELECT m.station_id, m.window_min, m.end_min, grid_peak_mmh, grid3x3_peak_mmh, round(grid_mm * 60 / m.window_min, 6) AS grid_rate_mmh FROM matched m LEFT JOIN pk3 USING (station_id, window_min, end_min)"))
def event_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Grid peaks and mean rate of each event, at the point and in 3 x 3 cells."""
    m = ref.matched(spark, sf, peaks=True)
    return m.select("station_id", "window_min", "end_min", "grid_peak_mmh", "grid3x3_peak_mmh", F.round(F.col("grid_mm") * 60 / F.col("window_min"), 6).alias("grid_rate_mmh"))


@query(sql(ref.ST, """SELECT station_id, m[1] AS lon_idx, m[2] AS lat_idx FROM (SELECT s.station_id, max((c.lon_idx, c.lat_idx)) AS m FROM st s JOIN cv_imerg_grid_cells c ON s.lon BETWEEN round(c.lon - 0.05, 6) AND round(c.lon + 0.05, 6) AND s.lat BETWEEN round(c.lat - 0.05, 6) AND round(c.lat + 0.05, 6) GROUP BY s.station_id)"""))
def region_last_match(spark: SparkSession, sf: str) -> DataFrame:
    """The region of each station where borders belong to all regions beside them and the last one counts."""
    rows = near.containing(ref.stations(spark, sf), near.cell_edges(table(spark, sf, "cv_imerg_grid_cells")), "station_id", closed=True)
    return rows.groupBy("station_id").agg(F.max("region").alias("r")).select("station_id", "r.lon_idx", "r.lat_idx")


def metrics_sql(distance: bool = False) -> str:
    a, out = "event_accum_mm", ["count(*) AS events", "count(DISTINCT station_id) AS stations"]
    share = lambda test: f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"
    for k, c, steps in (("point", "grid_mm", "positive_steps"), ("3x3", "grid3x3_mm", "positive_steps_3x3")):
        named = {
            "pod": share(f"{steps} > 0"), "median_ratio": f"median({c} / {a})", "median_ratio_hits": f"median({c} / {a}) FILTER (WHERE {steps} > 0)", "mean_ratio": f"avg({c} / {a})", "median_bias_mm": f"median({c} - {a})", "mae_mm": f"avg(abs({c} - {a}))",
            "rmse_mm": f"sqrt(avg(pow({c} - {a}, 2)))", "underestimate_fraction": share(f"{c} < {a}"), "zero_response_fraction": share(f"{c} <= 0"), "median_grid_mm": f"median({c})",
        }
        out += [f"round({x} + 1e-10::DOUBLE, 6) AS {name}_{k}" for name, x in named.items()]
    return ", ".join(out + [f"round(median({a}), 6) AS median_gauge_mm"] + (["round(median(distance_km), 6) AS median_distance_km"] if distance else []))


@query(sql(ref.MATCHED, f"SELECT 'all' AS scope, {metrics_sql()} FROM matched UNION ALL SELECT CAST(window_min AS VARCHAR), {metrics_sql()} FROM matched GROUP BY window_min"))
def event_skill(spark: SparkSession, sf: str) -> DataFrame:
    """All event metrics, over all events and per window."""
    return verify.event_metrics(ref.matched(spark, sf), ["coalesce(CAST(window_min AS STRING), 'all') AS scope"], "((), (window_min))")


_TOTAL = "point_tp + point_fp + point_fn + point_tn"
_RANDOM = {p: f"round((CAST({p}_tp AS DOUBLE) + {p}_fp) * ({p}_tp + {p}_fn) / ({_TOTAL}), 6)" for p in ("point", "best")}


@query(sql(ref.CONF, f", s AS (SELECT window_min, mode, stride, {ref._COUNTS} FROM c3 GROUP BY ALL) SELECT window_min, mode, stride, {_TOTAL} AS total_windows, {_RANDOM['point']} AS random_hits_point, {_RANDOM['best']} AS random_hits_best FROM s"))
def window_confusion_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and the hits expected by chance behind each 2x2 table."""
    rows = ref.confusion(spark, sf, ["window_min"])
    return rows.select("window_min", "mode", "stride", F.expr(_TOTAL).alias("total_windows"), *[F.expr(e).alias(f"random_hits_{p}") for p, e in _RANDOM.items()])


_STRICT_THR = ", ".join(["thr AS (SELECT station_id, window_min, round(quantile_cont(accum_mm, 0.995) FILTER (WHERE complete_strict AND accum_mm > 0), 6) AS threshold_mm FROM win GROUP BY ALL)"])


@query(sql(ref.SAT.replace(ref.IV, ref.WIN + ",\n" + _STRICT_THR) + ref.CONF.removeprefix(ref.SAT + ref.GT).replace("JOIN gt USING", "JOIN thr USING"), f"SELECT window_min, mode, stride, {ref._COUNTS} FROM c3 GROUP BY ALL"))
def window_confusion_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """2x2 tables with the catalogue's strict thresholds for the gauges."""
    base = ref.shared(spark, sf)
    regular = cut(win_ops.reference_windows(win_ops.half_hour_bins(base)))
    gauge = cut(ev.pot_thresholds(ref.win(spark, sf, base), mode="strict").select("station_id", "window_min", "threshold_mm"))
    return verify.window_confusion(regular, ref.at_gauges(spark, sf, ref.grid(spark, sf, base), regular), gauge, ["window_min"])


# ---------------------------------------------------------------- baseline per station and cell

_BY_CELL = ref.AREA.replace("(c.lon_idx // 3) * 10000 + c.lat_idx // 3 AS area", "c.lon_idx * 100000 + c.lat_idx AS area, c.lon_idx, c.lat_idx")


@query(sql(ref.REF + ref.GT + _BY_CELL, """SELECT station_id, window_min, count(*) AS n_windows, max(n) AS stations_in_cell, count(*) FILTER (WHERE accum_mm >= threshold_mm AND lo.m >= threshold_mm) AS tp, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND lo.m >= threshold_mm) AS fp,
 count(*) FILTER (WHERE accum_mm >= threshold_mm AND NOT lo.m >= threshold_mm) AS fn, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND NOT lo.m >= threshold_mm) AS tn, round(avg(lo.m - accum_mm), 6) AS bias_mm FROM ar JOIN md USING (area, ref_end, window_min) LEFT JOIN lo USING (station_id, ref_end, window_min) GROUP BY station_id, window_min"""))
def baseline_by_station(spark: SparkSession, sf: str) -> DataFrame:
    """Each station against the other stations of its grid cell, with the number of stations there."""
    regular, gauge = ref.ref_and_thresholds(spark, sf)
    rows = regular.filter("strict").select("station_id", "ref_end", "window_min", "accum_mm").join(ref.single_cells(spark, sf), "station_id").join(gauge.filter("threshold_mm > 0"), ["station_id", "window_min"])
    rows = verify.group_medians(rows, ["area", "ref_end", "window_min"])
    hit, found = "accum_mm >= threshold_mm", "loo_median >= threshold_mm"
    cell = lambda a, b: n(f"coalesce({a}({hit}) AND {b}({found}), false)")
    return rows.groupBy("station_id", "window_min").agg(
        F.count("*").alias("n_windows"), F.max("stations").alias("stations_in_cell"), cell("", "").alias("tp"), cell("NOT ", "").alias("fp"), cell("", "NOT ").alias("fn"), cell("NOT ", "NOT ").alias("tn"), F.round(F.avg(F.expr("loo_median - accum_mm")), 6).alias("bias_mm"),
    )


# ---------------------------------------------------------------- policy


@query(sql(ref.POL + ref.SUP.removeprefix(ref.EV).replace(ref.ST + ",", "", 1), """, e AS (SELECT pol.*, sp.neighbour_candidates, sp.neighbour_supporting, ev.suspect_count, ev.event_accum_mm FROM pol JOIN sp USING (station_id, window_min, end_min) JOIN (SELECT station_id, window_min, end_min, suspect_count, event_accum_mm FROM ev) ev USING (station_id, window_min, end_min))
SELECT station_id, window_min, end_min, excluded, 'suspect ' || suspect_count || ', support ' || neighbour_supporting || ' of ' || neighbour_candidates || ', nearest ' || printf('%.1f', max_neighbour_mm) || ' mm' AS evidence, row_number() OVER (ORDER BY excluded DESC, window_min, event_accum_mm DESC, end_min, station_id) AS place FROM e"""))
def policy_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Audited events with the evidence as text, excluded ones first, then by window and size (a report of forty events)."""
    base = ref.shared(spark, sf)
    keys = ["station_id", "window_min", "end_min"]
    beside = spatial.radius_neighbours(ref.stations(spark, sf)).select("station_id", "neighbour_id", "distance_km")
    events = ref.catalog(spark, sf, base)
    rows = ref.policy(spark, sf, base).join(ev.neighbour_support(events, beside, base).select(*keys, "neighbour_candidates", "neighbour_supporting"), keys).join(events.select(*keys, "suspect_count", "event_accum_mm"), keys)
    text = F.concat(F.lit("suspect "), F.col("suspect_count"), F.lit(", support "), F.col("neighbour_supporting"), F.lit(" of "), F.col("neighbour_candidates"), F.lit(", nearest "), F.format_string("%.1f", "max_neighbour_mm"), F.lit(" mm"))
    first = Window.orderBy(F.col("excluded").desc(), "window_min", F.col("event_accum_mm").desc(), "end_min", "station_id")
    return rows.select(*keys, "excluded", text.alias("evidence"), F.row_number().over(first).cast("bigint").alias("place"))


# ---------------------------------------------------------------- SQL for queries registered elsewhere

_HALF = "pow(sin(radians({x}) / 2), 2)"
_H = f"{_HALF.format(x='dj * 0.1::DOUBLE')} + cos(radians(a.lat)) * cos(radians(a.lat + dj * 0.1::DOUBLE)) * {_HALF.format(x='di * 0.1::DOUBLE')}"
DIST = ref.DISP + f""",
dk AS (SELECT d.*, round(2 * 6371.0::DOUBLE * asin(sqrt({_H})), 6) AS distance_km FROM disp d LEFT JOIN cell c ON c.station_id = d.station_id LEFT JOIN (SELECT DISTINCT lat_idx, lat FROM cv_imerg_grid_cells) a ON a.lat_idx = c.lat_idx)"""
_SHARE = "round(avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END), 6)"
_MOVED = f"""count(*) AS events, count(DISTINCT station_id) AS stations, round(median(distance_km), 6) AS median_distance_km, round(quantile_cont(distance_km, 0.9), 6) AS p90_distance_km, {_SHARE.format(x='same_cell')} AS fraction_same_cell, {_SHARE.format(x='NOT same_cell')} AS fraction_displaced,
 {_SHARE.format(x='improves')} AS fraction_gain_positive, round(median(gain_mm), 6) AS median_gain_mm, round(median(gain_ratio), 6) AS median_gain_ratio, round(median(point_mm / event_accum_mm), 6) AS median_point_recovery_ratio, round(median(recovery_ratio), 6) AS median_3x3_recovery_ratio,
 round(sum(event_accum_mm), 4) AS gauge_sum_mm, round(sum(point_mm), 4) AS point_sum_mm, round(sum(best_mm), 4) AS best_sum_mm"""
_CASES = ref.CASE.removeprefix(ref.MATCHED) + ", cs AS (SELECT day FROM cd ORDER BY station_count DESC, gauge_sum_mm DESC, event_count DESC, day LIMIT 2)"
_STATS = DIST + _CASES + f""",
st_ AS (SELECT 'all' AS scope, NULL::BIGINT AS day, NULL::BIGINT AS window_min, {_MOVED} FROM dk UNION ALL SELECT 'window', NULL, window_min, {_MOVED} FROM dk GROUP BY window_min UNION ALL SELECT 'case', end_min // 1440, window_min, {_MOVED} FROM dk WHERE end_min // 1440 IN (SELECT day FROM cs) GROUP BY ALL)"""
_NAMES = [part.rsplit(" AS ", 1)[1] for part in metrics_sql().split(", ") if " AS " in part]
_ORDERED = {"events", "stations"}
_SCENARIO = ref.POL + ref.MATCHED.removeprefix(ref.EV).replace(ref.ST + ",\n", "", 1) + f""", b AS (SELECT 'baseline' AS scenario, * FROM matched UNION ALL SELECT 'filtered', * FROM matched WHERE (station_id, window_min, end_min) NOT IN (SELECT (station_id, window_min, end_min) FROM pol WHERE excluded)),
s AS (SELECT scenario, 'all' AS scope, {metrics_sql()} FROM b GROUP BY scenario UNION ALL SELECT scenario, CAST(window_min AS VARCHAR), {metrics_sql()} FROM b GROUP BY scenario, window_min)"""
_STRATA_FAMILY = ref._STRATA_SQL.replace("SELECT m.*, altitude_group", "SELECT m.*, distance_km, altitude_group").replace("JOIN altitude USING (station_id)", "JOIN altitude USING (station_id) LEFT JOIN (SELECT station_id, window_min, end_min, distance_km FROM dk) k USING (station_id, window_min, end_min)")

ORACLES |= {
    "displacement_distance": sql(DIST, "SELECT * FROM dk"),
    "displacement_statistics": sql(_STATS, "SELECT * FROM st_"),
    "fig_displacement": sql(_STATS, "SELECT scope, day, window_min, events, median_distance_km, p90_distance_km, fraction_same_cell, fraction_displaced, fraction_gain_positive, median_gain_mm, median_point_recovery_ratio, median_3x3_recovery_ratio FROM st_ WHERE scope <> 'all'"),
    "stratified_metrics": sql(DIST, f", {_STRATA_FAMILY} SELECT family, stratum, 'all' AS scale, {metrics_sql(True)} FROM sf GROUP BY family, stratum UNION ALL SELECT family, stratum, CAST(window_min AS VARCHAR), {metrics_sql(True)} FROM sf GROUP BY family, stratum, window_min"),
    "policy_skill": sql(_SCENARIO, f"SELECT * FROM s UNION ALL SELECT 'delta', scope, {', '.join(f'f.{c} - b.{c}' if c in _ORDERED else f'round(f.{c} - b.{c}, 6)' for c in _NAMES)} FROM (SELECT * FROM s WHERE scenario = 'baseline') b JOIN (SELECT * FROM s WHERE scenario = 'filtered') f USING (scope)"),
    "fig_stratification": ref.ORACLES["stratified_skill"].replace("SELECT family, stratum, 'all' AS scale", ", fs AS (SELECT family, stratum, 'all' AS scale", 1) + ") SELECT family, stratum, scale, events, median_ratio_3x3 FROM (SELECT DISTINCT family, stratum FROM fs WHERE family IN ('season', 'coast')) CROSS JOIN (SELECT unnest(['30', '60', '180', '360']) AS scale) LEFT JOIN fs USING (family, stratum, scale)",
    "cell_medians_by_cell": sql(ref.REF + ref.GT + _BY_CELL, "SELECT ar.station_id, ar.lon_idx, ar.lat_idx, ar.ref_end, ar.window_min, md.n AS stations, round(md.m, 4) AS median_mm, round(lo.m, 4) AS loo_median_mm FROM ar JOIN md USING (area, ref_end, window_min) LEFT JOIN lo ON lo.station_id = ar.station_id AND lo.ref_end = ar.ref_end AND lo.window_min = ar.window_min"),
    "areal_baseline_by_cell": ref.ORACLES["areal_baseline"].replace(ref.AREA, _BY_CELL),
    "fig_ets_four_curves": ref.ORACLES["window_confusion_scale"].rsplit(" SELECT *, ", 1)[0]
    + _BY_CELL.replace(",\n" + ref.CELL, "")
    + f""", b AS (SELECT ar.accum_mm, ar.threshold_mm, ar.window_min, 'multi' AS subset, md.m FROM ar JOIN md USING (area, ref_end, window_min) WHERE n >= 2 UNION ALL SELECT ar.accum_mm, ar.threshold_mm, ar.window_min, 'loo', lo.m FROM ar JOIN lo USING (station_id, ref_end, window_min)),
c AS (SELECT window_min, subset, count(*) FILTER (WHERE accum_mm >= threshold_mm AND m >= threshold_mm) AS tp, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND m >= threshold_mm) AS fp, count(*) FILTER (WHERE accum_mm >= threshold_mm AND NOT m >= threshold_mm) AS fn, count(*) FILTER (WHERE NOT accum_mm >= threshold_mm AND NOT m >= threshold_mm) AS tn FROM b GROUP BY ALL),
t AS (SELECT window_min, subset, {ref._SC['ets']} AS ets FROM c)
SELECT window_min, {verify.scores('point_tp', 'point_fp', 'point_fn', 'point_tn')['ets']} AS ets_point, {verify.scores('best_tp', 'best_fp', 'best_fn', 'best_tn')['ets']} AS ets_best, (SELECT ets FROM t WHERE t.window_min = s.window_min AND subset = 'multi') AS ets_multi_station_cells, (SELECT ets FROM t WHERE t.window_min = s.window_min AND subset = 'loo') AS ets_leave_one_out FROM s WHERE stride = 'scale_stride' AND mode = 'fixed'""",
}
