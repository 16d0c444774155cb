"""Distances, summaries and metrics of displacement, strata and policy on made events."""

import math

import pytest

import __spark_entry__ as entry
from pluvion.operators import verify
from pluvion.plans import reference


def test_distance_and_statistics(spark):
    d = spark.createDataFrame([("a", 30, 100, 10.0, 1, 0, 2.0, 4.0, False, 2.0, 2.0, 0.4, True), ("a", 60, 1500, 8.0, 0, 0, 3.0, 3.0, True, 0.0, 1.0, 0.375, False), ("a", 60, 1600, 8.0, 0, 1, 0.0, 3.0, False, 3.0, None, 0.375, True)], "station_id string, window_min bigint, end_min bigint, event_accum_mm double, di int, dj int, point_mm double, best_mm double, same_cell boolean, gain_mm double, gain_ratio double, recovery_ratio double, improves boolean")
    moved = verify.with_distance(d, spark.createDataFrame([("a", 5, 7)], "station_id string, lon_idx bigint, lat_idx bigint"), spark.createDataFrame([(7, 60.0), (7, 60.0)], "lat_idx bigint, lat double"))
    km = [r["distance_km"] for r in moved.orderBy("end_min").collect()]
    assert km == pytest.approx([6371 * math.radians(0.1) * 0.5, 0, 6371 * math.radians(0.1)], abs=1e-4)
    got = {(r["scope"], r["day"], r["window_min"]): r for r in verify.displacement_statistics(moved, spark.createDataFrame([(1,)], "day bigint")).collect()}
    assert set(got) == {("all", None, None), ("window", None, 30), ("window", None, 60), ("case", 1, 60)}
    assert got[("case", 1, 60)]["p90_distance_km"] == pytest.approx(0.9 * km[2], abs=1e-5) and got[("case", 1, 60)]["fraction_displaced"] == 0.5


def test_policy_deltas_and_registered(spark):
    rows = [("baseline", s, 30, 10.0, g, g + 1, int(g > 0), 1) for s, g in (("a", 0.0), ("b", 5.0), ("c", 8.0))]
    rows += [("filtered", *r[1:]) for r in rows[1:]]
    got = {(r["scenario"], r["scope"]): r for r in reference.policy_rows(spark.createDataFrame(rows, "scenario string, station_id string, window_min bigint, event_accum_mm double, grid_mm double, grid3x3_mm double, positive_steps int, positive_steps_3x3 int")).collect()}
    d = got[("delta", "30")]
    assert (d["events"], d["median_bias_mm_point"], d["mae_mm_3x3"]) == (-1, 1.5, pytest.approx(2.5 - 14 / 3, abs=1e-6)) and got[("delta", "all")]["pod_point"] == pytest.approx(1 / 3, abs=1e-6)
    assert {"displacement_statistics", "stratified_metrics", "policy_skill", "fig_event_pod", "fig_displacement", "fig_stratification"} <= set(entry.queries())
