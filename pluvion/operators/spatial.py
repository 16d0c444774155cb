"""Station and grid geometry: neighbours by radius, nearest neighbours, nearest cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvion.operators import near
from pluvion.session import cut


def radius_neighbours(stations: DataFrame, km: float = 15.0) -> DataFrame:
    """(station_id, neighbour_id, distance_km) of ordered pairs with 0 < distance <= km; co-located stations are left out."""
    other = stations.select(F.col("station_id").alias("neighbour_id"), "lat", "lon")
    return near.within(stations, other, km, "station_id", "neighbour_id").filter("distance_km > 1e-9 AND station_id <> neighbour_id")


def nearest_neighbours(stations: DataFrame, k: int = 3, km: float = 20.0) -> DataFrame:
    """(station_id, neighbour_id, distance_km, neighbour_rank) of the k nearest others, ties by id; co-located ones count.

    Searched within a radius that doubles for the stations that found fewer than k, up to half the globe.
    """
    other = stations.select(F.col("station_id").alias("neighbour_id"), "lat", "lon")
    line = Window.partitionBy("station_id").orderBy(F.round("distance_km", 9), "neighbour_id")
    ask, done = stations.select("station_id", "lat", "lon"), None
    while True:
        pairs = near.within(ask, other, km, "station_id", "neighbour_id").filter("station_id <> neighbour_id")
        ranked = cut(pairs.withColumn("neighbour_rank", F.row_number().over(line).cast("bigint")).filter(F.col("neighbour_rank") <= k))
        full = ranked.groupBy("station_id").count().filter(F.col("count") >= k).select("station_id")
        ask_next = cut(ask.join(full, "station_id", "left_anti"))
        last = km > 20_000 or ask_next.isEmpty()
        part = ranked if last else ranked.join(full, "station_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        ask, km = ask_next, 2 * km


def nearest_axis_cells(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Nearest cell on each axis by itself (lon_idx, lat_idx); the lower index on ties.  The axes are the grid's distinct
    coordinates (a few thousand at most), one array each, as scalar subqueries."""
    axis = lambda c: f"(SELECT collect_set(struct({c} AS v, {c}_idx AS i)) FROM {{c}})"
    near = lambda c: f"array_min(transform({c}_axis, x -> struct(round(abs({c} - x.v), 9) AS d, x.i AS i))).i AS {c}_idx"
    with_axes = stations.sparkSession.sql(f"SELECT *, {axis('lon')} AS lon_axis, {axis('lat')} AS lat_axis FROM {{s}} WHERE lat IS NOT NULL AND lon IS NOT NULL", s=stations, c=cells.select("lon", "lat", "lon_idx", "lat_idx"))
    return with_axes.selectExpr("*", near("lon"), near("lat")).drop("lon_axis", "lat_axis")


def nearest_inside_cells(stations: DataFrame, cells: DataFrame, step_deg: float = 0.1) -> DataFrame:
    """Nearest cell among those inside the polygon, by squared degrees; ties by (lon_idx, lat_idx).

    Cells are looked up in growing squares around the axis cell: an answer counts once nothing outside can be nearer.
    Stations still without a sure answer after 128 cells are compared with every inside cell.
    """
    inside = cells.filter("inside_cv_polygon").select("lon_idx", "lat_idx", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    ask, done, ring = cut(nearest_axis_cells(stations, cells).select("station_id", "lat", "lon", F.col("lon_idx").alias("i"), F.col("lat_idx").alias("j"))), None, 2
    order = Window.partitionBy("station_id").orderBy("d2", "lon_idx", "lat_idx")
    while True:
        around = F.sequence(F.lit(-ring), F.lit(ring))
        square = ask.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).withColumns({"lon_idx": F.col("i") + F.col("di"), "lat_idx": F.col("j") + F.col("dj")})
        hit = square.join(inside, ["lon_idx", "lat_idx"]).withColumn("d2", F.round(F.pow(F.col("lon") - F.col("c_lon"), 2) + F.pow(F.col("lat") - F.col("c_lat"), 2), 9))
        best = hit.withColumn("k", F.row_number().over(order)).filter("k = 1").select("station_id", "lon_idx", "lat_idx", "d2")
        sure = cut(best.filter(F.sqrt("d2") <= (ring + 0.5) * step_deg - 1e-9))
        done = sure if done is None else done.unionByName(sure)
        ask = cut(ask.join(sure, "station_id", "left_anti"))
        if ask.isEmpty():
            return done
        if ring >= 128:
            break
        ring *= 8
    d2 = F.round(F.pow(F.col("lon") - F.col("c_lon"), 2) + F.pow(F.col("lat") - F.col("c_lat"), 2), 9)
    rest = ask.crossJoin(inside).groupBy("station_id").agg(F.min(F.struct(d2.alias("d2"), "lon_idx", "lat_idx")).alias("b"))
    return done.unionByName(rest.select("station_id", "b.lon_idx", "b.lat_idx", "b.d2"))


KM_PER_DEGREE = 111.19492664455873  # on a sphere of radius 6371 km


def border_segments(cells: DataFrame) -> list[tuple[float, float, float, float]]:
    """Polyline (lon1, lat1, lon2, lat2) along the eastern border of the inside cells, a stand-in for a coastline: one
    vertex per grid row, so at most as many numbers as the grid has rows come to the driver."""
    rows = cells.filter("inside_cv_polygon").groupBy("lat_idx").agg(F.max("lon").alias("lon"), F.min("lat").alias("lat")).orderBy("lat_idx").collect()
    at = [(r["lon"], r["lat"]) for r in rows]
    return [(*a, *b) for a, b in zip(at, at[1:])]


def distance_to_line_km(lat: str, lon: str, segments: list[tuple[float, float, float, float]], middle_lat: float = 39.5) -> Column:
    """Distance from a position to the nearest of a line's segments, in a plane scaled at ``middle_lat``; NULL without
    position or segments."""
    kx, ky = KM_PER_DEGREE * math.cos(math.radians(middle_lat)), KM_PER_DEGREE
    px, py = F.col(lon) * kx, F.col(lat) * ky
    out = []
    for x1, y1, x2, y2 in segments:
        ax, ay, dx, dy = x1 * kx, y1 * ky, (x2 - x1) * kx, (y2 - y1) * ky
        size = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / (size or 1.0)))
        out.append(F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2)))
    if not out:
        return F.lit(None).cast("double")
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), out[0] if len(out) == 1 else F.least(*out))
