"""Verification of gridded rain against gauges: event matches, contingency scores, baselines, displacement, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.operators.windows import WINDOWS, time_chunks
from pluvion.session import cut


def scores(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn", prefix: str = "", rounded: bool = True) -> dict[str, str]:
    """SQL of the scores of a 2x2 table; a denominator that is not positive gives NULL.  Counts become doubles first."""
    a, b, c, d = (f"CAST({x} AS DOUBLE)" for x in (tp, fp, fn, tn))
    r = f"(({a} + {b}) * ({a} + {c}) / nullif({a} + {b} + {c} + {d}, 0))"
    ratio = {
        "pod": (a, f"({a} + {c})"), "far": (b, f"({a} + {b})"), "csi": (a, f"({a} + {b} + {c})"), "precision": (a, f"({a} + {b})"), "specificity": (d, f"({d} + {b})"),
        "bias": (f"({a} + {b})", f"({a} + {c})"), "ets": (f"({a} - {r})", f"({a} + {b} + {c} - {r})"),
        "hss": (f"(2 * ({a} * {d} - {c} * {b}))", f"(({a} + {c}) * ({c} + {d}) + ({a} + {b}) * ({b} + {d}))"),
    }
    sql = {prefix + k: f"CASE WHEN {y} > 0 THEN {x} / nullif({y}, 0) END" for k, (x, y) in ratio.items()}
    return {k: f"round({x}, 6)" for k, x in sql.items()} if rounded else sql


def stencil(cells: DataFrame) -> DataFrame:
    """(station_id, lon_idx, lat_idx, di, dj): the 3 x 3 cells around each station's cell."""
    off = F.array(F.lit(-1), F.lit(0), F.lit(1))
    nine = cells.withColumn("di", F.explode(off)).withColumn("dj", F.explode(off))
    return nine.select("station_id", (F.col("lon_idx") + F.col("di")).alias("lon_idx"), (F.col("lat_idx") + F.col("dj")).alias("lat_idx"), "di", "dj")


def smoothed_grid(bins: DataFrame, cells: DataFrame) -> DataFrame:
    """A gridded rain series derived from the gauges, as a stand-in for satellite fields: (step, lon_idx, lat_idx, rate).

    Every half-hour's rain reaches the 3 x 3 cells around its station one step later, a little more to the east and
    less to the north; a cell's rate (mm/h) is the average over the stations that reach it.
    """
    rows = bins.filter("fail = 0 AND minutes >= 15").join(stencil(cells), "station_id")
    weight = 1 + 0.1 * F.col("di") - 0.05 * F.col("dj")
    return rows.groupBy((F.col("bin") + 1).alias("step"), "lon_idx", "lat_idx").agg(F.round(F.avg(F.col("mass") * 2 * weight), 9).alias("rate"))


def event_cells(events: DataFrame, cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Per event and each of its 3 x 3 cells: rain over the event (mm), peak rate, steps; equi-joins on step and cell."""
    keys = ["station_id", "window_min", "end_min"]
    steps = events.select(*keys, "event_accum_mm", F.explode(F.expr("sequence((end_min - window_min) div 30, (end_min - 1) div 30)")).alias("step"))
    steps = steps.join(grid.select("step").distinct(), "step", "left_semi").withColumn("overlap", F.expr("least(end_min, step * 30 + 30) - greatest(end_min - window_min, step * 30)"))
    rows = steps.join(stencil(cells), "station_id").join(grid, ["step", "lon_idx", "lat_idx"], "left")
    return rows.groupBy(*keys, "di", "dj", "lon_idx", "lat_idx").agg(
        F.max("event_accum_mm").alias("event_accum_mm"), F.sum(F.col("rate") * F.col("overlap") / 60.0).alias("mm"), F.max("rate").alias("peak"), F.count("rate").alias("valid"),
        F.sum("overlap").alias("minutes"), F.count("*").alias("steps"), F.sum((F.col("rate") > 0).cast("bigint")).alias("positive"),
    )


def event_match(events: DataFrame, cells: DataFrame, grid: DataFrame, peaks: bool = False) -> DataFrame:
    """Events with grid rain at the point and the largest accumulation of the 3 x 3 cells (max of sums), coverage and steps.

    The point total is 0 where steps exist but the cell has no value, NULL where no step overlaps.
    """
    keys = ["station_id", "window_min", "end_min"]
    per = event_cells(events, cells, grid)
    point = F.expr("di = 0 AND dj = 0")
    got = per.groupBy(*keys).agg(
        F.round(F.coalesce(F.max(F.when(point, F.col("mm"))), F.lit(0.0)), 6).alias("grid_mm"), F.round(F.coalesce(F.max("mm"), F.lit(0.0)), 6).alias("grid3x3_mm"), F.max(F.when(point, F.col("peak"))).alias("grid_peak_mmh"), F.max("peak").alias("grid3x3_peak_mmh"),
        F.max("steps").alias("grid_steps"), F.max("minutes").alias("grid_minutes"), F.coalesce(F.max(F.when(point, F.col("positive"))), F.lit(0)).alias("positive_steps"), F.coalesce(F.max("positive"), F.lit(0)).alias("positive_steps_3x3"),
    )
    expected = F.expr("CAST(floor((end_min - 1) / 30) - ceil((end_min - window_min - 29) / 30) + 1 AS BIGINT)")
    out = events.select(*keys, "event_accum_mm").join(got, keys, "left").withColumn("expected_steps", expected).withColumn("grid_steps", F.coalesce("grid_steps", F.lit(0)))
    out = out.withColumns({"missing_steps": F.greatest(F.lit(0), F.col("expected_steps") - F.col("grid_steps")), "grid_coverage": F.round(F.coalesce("grid_minutes", F.lit(0)) / F.col("window_min"), 6)})
    out = out.withColumn("complete_window", F.expr("expected_steps > 0 AND missing_steps = 0 AND grid_coverage >= 0.999")).drop("grid_minutes")
    return out if peaks else out.drop("grid3x3_peak_mmh")


def skill(matched: DataFrame, scope_sets: str = "((), (window_min))") -> DataFrame:
    """Event skill over all events and per window (grouping sets): detection, bias, errors, ratios, zero responses."""
    return matched.sparkSession.sql(
        f"""SELECT coalesce(CAST(window_min AS STRING), 'all') AS scope, count(*) AS events,
          round(avg(CASE WHEN positive_steps > 0 THEN 1.0D ELSE 0.0D END), 6) AS pod_point, round(avg(CASE WHEN positive_steps_3x3 > 0 THEN 1.0D ELSE 0.0D END), 6) AS pod_3x3,
          round(avg(grid_mm - event_accum_mm), 6) AS bias_mm, round(avg(abs(grid_mm - event_accum_mm)), 6) AS mae_mm, round(sqrt(avg((grid_mm - event_accum_mm) * (grid_mm - event_accum_mm))), 6) AS rmse_mm,
          round(percentile(grid_mm / event_accum_mm, 0.5D), 6) AS median_ratio, round(avg(grid_mm / event_accum_mm), 6) AS mean_ratio, round(percentile(grid3x3_mm / event_accum_mm, 0.5D), 6) AS median_ratio_3x3,
          round(percentile(CASE WHEN positive_steps > 0 THEN grid_mm / event_accum_mm END, 0.5D), 6) AS median_ratio_hits,
          round(100 * avg(CASE WHEN grid_mm < event_accum_mm THEN 1.0D ELSE 0.0D END), 6) AS underestimate_pct, round(100 * avg(CASE WHEN grid_mm = 0 THEN 1.0D ELSE 0.0D END), 6) AS zero_pct
        FROM {{m}} GROUP BY GROUPING SETS {scope_sets}""", m=matched)  # fmt: skip


def group_medians(rows: DataFrame, keys: list[str], value: str = "accum_mm") -> DataFrame:
    """``rows`` with ``stations``, ``area_median`` and ``loo_median`` (of the other rows of the group, NULL if none).

    Both come from the group's sorted values by rank, without pairs: the group's middle values are attached to its rows.
    """
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value, "station_id"))).withColumn("stations", F.count("*").over(Window.partitionBy(*keys)))
    low = F.expr("(stations + 1) div 2")
    middle = ranked.filter(F.col("__r").between(low - 1, low + 2)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("__r") - low).alias("k"), F.col(value).alias("v")))).alias("__m"))
    out = ranked.join(middle, keys).withColumn("__o", F.col("__r") - low)
    # of n sorted values without rank r, the k-th is number k, or k + 1 from r on; offsets are from rank (n + 1) div 2
    return out.withColumns({
        "area_median": F.expr("CASE WHEN stations % 2 = 1 THEN __m[0L] ELSE (__m[0L] + __m[1L]) / 2 END"),
        "loo_median": F.expr("""CASE WHEN stations < 2 THEN NULL WHEN stations % 2 = 0 THEN CASE WHEN __o <= 0 THEN __m[1L] ELSE __m[0L] END
          ELSE ((CASE WHEN __o <= -1 THEN __m[0L] ELSE __m[-1L] END) + (CASE WHEN __o <= 0 THEN __m[1L] ELSE __m[0L] END)) / 2 END"""),
    }).drop("__r", "__m", "__o")


def event_metrics(rows: DataFrame, keys: list[str], sets: str) -> DataFrame:
    """Event skill per grouping set of ``keys``, at the point and in 3 x 3 cells; with ``distance_km`` its median.

    Detection, ratios (over all events and over those with a response), bias, errors, shares of events that are
    underestimated or without response, and the medians of both sides.  An event without grid rain counts as not
    underestimated and not without response.  Halves of the last digit are rounded up, however they were added up.
    """
    both = lambda name, f: ", ".join(f"round({f(c, n)} + 1e-10D, 6) AS {name}_{k}" for k, c, n in (("point", "grid_mm", "positive_steps"), ("3x3", "grid3x3_mm", "positive_steps_3x3")))
    share = lambda test: f"avg(CASE WHEN {test} THEN 1.0D ELSE 0.0D END)"
    a = "event_accum_mm"
    return rows.sparkSession.sql(
        f"""SELECT {', '.join(keys)}, count(*) AS events, count(DISTINCT station_id) AS stations, {both('pod', lambda c, n: share(f'{n} > 0'))},
          {both('median_ratio', lambda c, n: f'percentile({c} / {a}, 0.5D)')}, {both('median_ratio_hits', lambda c, n: f'percentile(CASE WHEN {n} > 0 THEN {c} / {a} END, 0.5D)')}, {both('mean_ratio', lambda c, n: f'avg({c} / {a})')},
          {both('median_bias_mm', lambda c, n: f'percentile({c} - {a}, 0.5D)')}, {both('mae_mm', lambda c, n: f'avg(abs({c} - {a}))')}, {both('rmse_mm', lambda c, n: f'sqrt(avg(({c} - {a}) * ({c} - {a})))')},
          {both('underestimate_fraction', lambda c, n: share(f'{c} < {a}'))}, {both('zero_response_fraction', lambda c, n: share(f'{c} <= 0'))},
          {both('median_grid_mm', lambda c, n: f'percentile({c}, 0.5D)')}, round(percentile({a}, 0.5D), 6) AS median_gauge_mm
          {", round(percentile(distance_km, 0.5D), 6) AS median_distance_km" if "distance_km" in rows.columns else ""} FROM {{r}} GROUP BY GROUPING SETS {sets}""", r=rows)  # fmt: skip


def with_distance(displaced: DataFrame, cells: DataFrame, axis: DataFrame, step: float = 0.1) -> DataFrame:
    """``displaced`` with the haversine distance from the station's cell centre to the best cell's; ``axis``: lat of each lat_idx."""
    lat = cells.join(axis.select("lat_idx", "lat").distinct(), "lat_idx").select("station_id", "lat")
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(F.col("dj") * step) + F.cos(F.radians("lat")) * F.cos(F.radians(F.col("lat") + F.col("dj") * step)) * half(F.col("di") * step)
    return displaced.join(lat, "station_id", "left").withColumn("distance_km", F.round(2 * 6371.0 * F.asin(F.sqrt(h)), 6)).drop("lat")


def displacement_statistics(rows: DataFrame, case: DataFrame) -> DataFrame:
    """Amplitude and displacement over all events, per window, and per case day and window (``case``: day)."""
    days = rows.withColumn("day", F.expr("end_min div 1440")).join(F.broadcast(case.select("day")), "day")
    share = lambda test: f"round(avg(CASE WHEN {test} THEN 1.0D ELSE 0.0D END), 6)"
    median = lambda c, q=0.5: f"round(percentile({c}, {q}D), 6)"
    stats = f"""count(*) AS events, count(DISTINCT station_id) AS stations, {median('distance_km')} AS median_distance_km, {median('distance_km', 0.9)} AS p90_distance_km, {share('same_cell')} AS fraction_same_cell,
      {share('NOT same_cell')} AS fraction_displaced, {share('improves')} AS fraction_gain_positive, {median('gain_mm')} AS median_gain_mm, {median('gain_ratio')} AS median_gain_ratio, {median('point_mm / event_accum_mm')} AS median_point_recovery_ratio,
      {median('recovery_ratio')} AS median_3x3_recovery_ratio, round(sum(event_accum_mm), 4) AS gauge_sum_mm, round(sum(point_mm), 4) AS point_sum_mm, round(sum(best_mm), 4) AS best_sum_mm"""
    return rows.sparkSession.sql(
        f"""SELECT CASE WHEN window_min IS NULL THEN 'all' ELSE 'window' END AS scope, CAST(NULL AS BIGINT) AS day, window_min, {stats} FROM {{r}} GROUP BY GROUPING SETS ((), (window_min))
        UNION ALL SELECT 'case', day, window_min, {stats} FROM {{d}} GROUP BY day, window_min""", r=rows, d=days)  # fmt: skip


def satellite_windows(grid: DataFrame, cells: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per station, half-hour end and window: grid rain at the point and of the largest cell per half-hour (sum of
    maxima); strict only if every half-hour of the window has a value."""
    rows = stencil(cells).join(grid, ["lon_idx", "lat_idx"]).groupBy("station_id", "step").agg(F.max(F.when(F.expr("di = 0 AND dj = 0"), F.col("rate"))).alias("point"), F.max("rate").alias("best"))
    rows = time_chunks(rows.withColumn("ref_end", F.col("step") * 30 + 30), "ref_end", max(windows))
    line = Window.partitionBy("station_id", "__chunk").orderBy("ref_end")
    for w in windows:
        x = line.rangeBetween(-(w - 30), 0)
        rows = rows.withColumn(f"w{w}", F.struct(F.lit(w).cast("bigint").alias("window_min"), F.round(F.sum("point").over(x) / 2, 6).alias("point_mm"), F.round(F.sum("best").over(x) / 2, 6).alias("best_mm"), (F.count("point").over(x) * 30 >= w * 0.95).alias("sat_strict")))
    return rows.filter("__own").select("station_id", "ref_end", F.inline(F.array(*[f"w{w}" for w in windows])))


def wet_quantiles(sat: DataFrame, q: float = 0.995) -> DataFrame:
    """Per station and window: the quantile of wet complete satellite windows, at the point and 3 x 3."""
    pick = lambda c: F.round(F.percentile(F.when(F.col("sat_strict") & (F.col(c) > 0), F.col(c)), q), 6)
    return sat.groupBy("station_id", "window_min").agg(pick("point_mm").alias("q_point"), pick("best_mm").alias("q_best"))


def window_confusion(ref: DataFrame, sat: DataFrame, gauge: DataFrame, keys: list[str]) -> DataFrame:
    """2x2 counts per ``keys`` (of station_id, window_min, day) and threshold mode and stride, at the point and 3 x 3.

    All modes and strides are counted side by side in one aggregation, and become rows afterwards.
    """
    rows = ref.filter("strict").join(sat.filter("sat_strict"), ["station_id", "ref_end", "window_min"])
    rows = rows.join(gauge.filter("threshold_mm > 0").select("station_id", "window_min", "threshold_mm"), ["station_id", "window_min"]).join(wet_quantiles(sat), ["station_id", "window_min"])
    modes = {"fixed": ("point_mm >= threshold_mm", "best_mm >= threshold_mm"), "relative": ("point_mm >= q_point", "best_mm >= q_best")}
    flags = {"a_": "accum_mm >= threshold_mm", "s_": "ref_end % window_min = 0"} | {f"{m}_{k}": f"coalesce({e}, false)" for m, two in modes.items() for k, e in zip(("point", "best"), two)}
    rows = rows.select(*{*keys, "window_min"} - {"day"}, F.expr("ref_end div 1440").alias("day"), *[F.expr(e).alias(k) for k, e in flags.items()])
    cells = {"tp": "a_ AND {x}", "fp": "NOT a_ AND {x}", "fn": "a_ AND NOT {x}", "tn": "NOT a_ AND NOT {x}"}
    strides = {"overlap": "true", "scale_stride": "s_"}
    count = lambda test, name: F.sum(F.expr(f"CAST({test} AS BIGINT)")).alias(name)
    sums = [count(f"{on} AND {test.format(x=f'{m}_{k}')}", f"{m}_{stride}_{k}_{c}") for m in modes for stride, on in strides.items() for k in ("point", "best") for c, test in cells.items()]
    wide = rows.groupBy(*keys).agg(*sums, count("s_", "n_"))
    item = lambda m, stride: F.struct(F.lit(m).alias("mode"), F.lit(stride).alias("stride"), *[F.col(f"{m}_{stride}_{k}_{c}").alias(f"{k}_{c}") for k in ("point", "best") for c in cells])
    some = F.col("n_") > 0
    return wide.select(*keys, F.inline(F.array_compact(F.array(*[F.when(F.lit(stride == "overlap") | some, item(m, stride)) for m in modes for stride in strides]))))


def areal_baseline(ref: DataFrame, areas: DataFrame, gauge: DataFrame) -> DataFrame:
    """Each station against the median of its area, and against the median of the other stations there (leave one out)."""
    rows = ref.filter("strict").select("station_id", "ref_end", "window_min", "accum_mm").join(areas, "station_id").join(gauge.filter("threshold_mm > 0").select("station_id", "window_min", "threshold_mm"), ["station_id", "window_min"])
    rows = group_medians(rows, ["area", "ref_end", "window_min"])
    kind = lambda name, c, ok: F.when(ok, F.struct(F.lit(name).alias("subset"), F.col(c).alias("m")))
    many = F.col("stations") >= 2
    rows = rows.select("*", F.explode(F.array_compact(F.array(kind("all_cells", "area_median", F.lit(True)), kind("multi_station_cells", "area_median", many), kind("leave_one_out", "loo_median", many)))).alias("s"))
    cell = lambda a, b: F.sum(F.expr(f"CAST({a}(accum_mm >= threshold_mm) AND {b}(s.m >= threshold_mm) AS BIGINT)"))
    return rows.groupBy("window_min", "s.subset").agg(
        cell("", "").alias("tp"), cell("NOT ", "").alias("fp"), cell("", "NOT ").alias("fn"), cell("NOT ", "NOT ").alias("tn"), F.round(F.avg(F.expr("s.m - accum_mm")), 6).alias("bias_mm"), F.round(F.avg(F.expr("abs(s.m - accum_mm)")), 6).alias("mae_mm"),
    )


def displacement(events: DataFrame, cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Where in the 3 x 3 cells an event's grid rain is largest: ties to the centre, then by index; none above 0: the centre."""
    keys = ["station_id", "window_min", "end_min"]
    per = event_cells(events, cells, grid).withColumn("mm", F.round("mm", 6))
    top = Window.partitionBy(*keys)
    per = per.withColumn("top", F.max("mm").over(top)).withColumn("d2", F.expr("di * di + dj * dj"))
    pick = per.withColumn("cand", F.expr("CASE WHEN coalesce(top, 0) <= 0 THEN di = 0 AND dj = 0 ELSE mm >= top - 1e-7D END")).groupBy(*keys).agg(
        F.min(F.when(F.col("cand"), F.struct("d2", "di", "dj"))).alias("b"), F.round(F.coalesce(F.max(F.when(F.col("d2") == 0, F.col("mm"))), F.lit(0.0)), 6).alias("point_mm"),
        F.round(F.coalesce(F.max("mm"), F.lit(0.0)), 6).alias("best_mm"), F.sum((F.col("valid") > 0).cast("bigint")).alias("valid_cells"), F.max("event_accum_mm").alias("event_accum_mm"),
    )
    out = pick.select(*keys, "event_accum_mm", F.col("b.di").alias("di"), F.col("b.dj").alias("dj"), "point_mm", "best_mm", "valid_cells")
    return out.withColumns({
        "same_cell": F.expr("di = 0 AND dj = 0"), "gain_mm": F.round(F.col("best_mm") - F.col("point_mm"), 6), "gain_ratio": F.expr("round(CASE WHEN point_mm > 0 THEN best_mm / nullif(point_mm, 0) END, 6)"),
        "recovery_ratio": F.round(F.col("best_mm") / F.col("event_accum_mm"), 6), "improves": F.col("best_mm") > F.col("point_mm"),
    })


def resampling(spark, replicates: int, blocks: int | dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """(replicate, block, times): how often each block is drawn, from numpy's generator, one draw of ``blocks`` integers a replicate.

    With a dict of scope: (blocks, seed) each scope has its own draws, named in ``scope``.  A scope's draws follow from one
    another, so one task makes them, replicate by replicate.
    """
    scopes = blocks if isinstance(blocks, dict) else {"": (blocks, seed)}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scope, n, start in b[["scope", "blocks", "seed"]].itertuples(index=False):
                rng = np.random.default_rng(start)
                for r in range(replicates):
                    times = np.bincount(rng.integers(0, n, size=n), minlength=n)
                    at = np.flatnonzero(times)
                    yield pd.DataFrame({"scope": scope, "replicate": r, "block": at, "times": times[at]})

    rows = spark.createDataFrame([(k, int(n), int(s)) for k, (n, s) in scopes.items()], "scope string, blocks bigint, seed bigint").repartition(len(scopes))
    plan = rows.mapInPandas(draw, "scope string, replicate bigint, block bigint, times bigint")
    return plan if isinstance(blocks, dict) else plan.drop("scope")


def bootstrap_counts(daily: DataFrame, days: DataFrame, replicates: int = 1000, seed: int = 42, prefixes: tuple[str, ...] = ("point", "best")) -> DataFrame:
    """Scores with percentile intervals (2.5, 97.5) when whole days are drawn with replacement, per window, mode and stride.

    ``daily``: one row per group and day with counts.  The blocks are all of the timeline's ``days``; a day without a row
    counts zeros.  Windows are drawn with seed ``seed`` + window; the groups of a window see the same draws.
    """
    group, names = ["window_min", "mode", "stride"], [f"{p}_{k}" for p in prefixes for k in ("tp", "fp", "fn", "tn")]
    sql = lambda rounded: {k: e for p in prefixes for k, e in scores(*[f"{p}_{x}" for x in ("tp", "fp", "fn", "tn")], prefix=f"{p}_", rounded=rounded).items()}
    numbered = days.select("day").distinct().withColumn("block", F.row_number().over(Window.orderBy("day")).cast("bigint") - 1)  # one row a day
    blocks = numbered.count()
    windows = sorted(r[0] for r in daily.select("window_min").distinct().collect())
    plan = resampling(daily.sparkSession, replicates, {str(w): (blocks, seed + w) for w in windows}).withColumn("window_min", F.col("scope").cast("bigint"))
    rows = daily.join(numbered, "day").join(plan, ["window_min", "block"]).groupBy(*group, "replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in names])
    rows = rows.select(*group, *[F.expr(e).alias(k) for k, e in sql(False).items()])
    ends = rows.groupBy(*group).agg(*[F.percentile(k, F.array(F.lit(0.025), F.lit(0.975))).alias(k) for k in sql(False)])
    ends = ends.select(*group, *[F.round(F.get(k, F.lit(i)), 6).alias(f"{k}_{e}") for k in sql(False) for i, e in enumerate(("low", "high"))])
    whole = daily.groupBy(*group).agg(*[F.sum(c).alias(c) for c in names]).select(*group, F.lit(blocks).cast("bigint").alias("blocks"), F.lit(replicates).cast("bigint").alias("replicates"), *[F.expr(e).alias(k) for k, e in sql(True).items()])
    return whole.join(ends, group, "left")


EVENT_MEANS = {
    "pod_point": "positive_steps > 0", "pod_3x3": "positive_steps_3x3 > 0", "zero_response_fraction_point": "grid_mm <= 0", "zero_response_fraction_3x3": "grid3x3_mm <= 0",
}
EVENT_MEDIANS = {
    "median_ratio_point": "grid_mm / event_accum_mm", "median_ratio_3x3": "grid3x3_mm / event_accum_mm", "median_bias_mm_point": "grid_mm - event_accum_mm", "median_bias_mm_3x3": "grid3x3_mm - event_accum_mm",
}


def bootstrap_events(matched: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Day-block bootstrap of event metrics, over all events (seed ``seed``) and per window (``seed`` + window).

    Blocks are the days with events of the scope.  Medians need the multiset, so each event counts as often as its day
    was drawn; the means come from the days' sums.
    """
    rows = matched.filter("grid_mm IS NOT NULL").withColumn("day", F.expr("end_min div 1440"))
    rows = rows.select("day", F.explode(F.array(F.lit("all"), F.col("window_min").cast("string"))).alias("scope"), *[F.expr(f"CAST({e} AS BIGINT)").alias(k) for k, e in EVENT_MEANS.items()], *[F.expr(e).alias(k) for k, e in EVENT_MEDIANS.items()])
    rows = cut(rows)
    mean = lambda w: [F.expr(f"sum({w}{k}) / sum({w}n)").alias(k) for k in EVENT_MEANS]
    days = rows.groupBy("scope", "day").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in EVENT_MEANS])
    days = cut(days.withColumn("block", F.row_number().over(Window.partitionBy("scope").orderBy("day")).cast("bigint") - 1))  # one row a scope and day
    sizes = {r["scope"]: r["count"] for r in days.groupBy("scope").count().collect()}
    plan = cut(resampling(matched.sparkSession, replicates, {k: (n, seed + (0 if k == "all" else int(k))) for k, n in sizes.items()}))
    drawn = days.join(plan, ["scope", "block"])
    means = drawn.groupBy("scope", "replicate").agg(*mean("times * "))
    medians = rows.join(drawn.select("scope", "day", "replicate", "times"), ["scope", "day"]).groupBy("scope", "replicate").agg(*[F.expr(f"percentile({k}, 0.5D, times)").alias(k) for k in EVENT_MEDIANS])
    item = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in (*EVENT_MEANS, *EVENT_MEDIANS)]))
    ends = means.join(medians, ["scope", "replicate"]).select("scope", item).groupBy("scope", "metric").agg(
        F.round(F.percentile("v", 0.025), 6).alias("low"), F.round(F.percentile("v", 0.975), 6).alias("high"), F.count("*").alias("replicates"),
    )
    whole = days.groupBy("scope").agg(F.sum("n").alias("events"), F.count("*").alias("blocks"), *mean(""))
    whole = whole.join(rows.groupBy("scope").agg(*[F.percentile(k, 0.5).alias(k) for k in EVENT_MEDIANS]), "scope").select("scope", "events", "blocks", item)
    return whole.withColumn("v", F.round("v", 6)).withColumnRenamed("v", "estimate").join(ends, ["scope", "metric"])
