"""Stations far from every inside cell still get the nearest one."""

from pluvion.operators import spatial


def test_far_station(spark):
    cells = spark.createDataFrame([(i, 0, round(0.1 * i, 1), 0.0, i in (0, 5, 400)) for i in range(401)], "lon_idx bigint, lat_idx bigint, lon double, lat double, inside_cv_polygon boolean")
    stations = spark.createDataFrame([("far", 0.01, 20.1), ("near", 0.0, 0.5)], "station_id string, lat double, lon double")
    got = {r["station_id"]: (r["lon_idx"], r["lat_idx"]) for r in spatial.nearest_inside_cells(stations, cells).collect()}
    assert got == {"far": (5, 0), "near": (5, 0)}
