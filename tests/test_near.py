"""Problem 6 against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pluvion.operators import near, spatial


def km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_within(spark):
    r = random.Random(1)
    pts = [(39 + r.random(), -1 + r.random()) for _ in range(300)]
    q = [(i, *(r.choice(pts[:3]) if i % 3 == 0 else (39 + r.random(), -1 + r.random())), "x") for i in range(600)] + [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x"), (902, 95.0, 0.0, "x"), (None, 39.5, -0.5, "x")]
    t = [(f"s{i}", *p, 1) for i, p in enumerate(pts)] + [("s0", *pts[0], 2), (None, *pts[1], 3), ("none", None, None, 4)]
    a = spark.createDataFrame(q, "id bigint, lat double, lon double, leaf string")
    b = spark.createDataFrame(t, "station string, lat double, lon double, part int")
    got = sorted(((-1 if x["id"] is None else x["id"], x["station"] or "") for x in near.within(a, b, 5.0, "id", "station", leaf_targets=20, task_rows=50).collect()))
    want = sorted((i if i is not None else -1, s or "") for i, la, lo, _ in q for s, pa, po, _ in t if la is not None and pa is not None and la == la and abs(la) <= 90 and km((la, lo), (pa, po)) <= 5.0)
    assert got == want and len(got) > 1000
    none = a.filter("id = -5")
    assert near.within(none, b, 5.0, "id", "station").count() == 0 == near.within(a, b.filter("part = 99"), 5.0, "id", "station").count()


def test_poles_date_line_and_large_radius(spark):
    pts = [(89.99, 0.0), (89.99, 180.0), (0.0, 179.999), (0.0, -179.999), (0.0, 0.0)]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lat double, lon double")
    b = a.withColumnRenamed("id", "other")
    got = {(r["id"], r["other"]) for r in near.within(a, b, 3.0, "id", "other", leaf_targets=1).collect()}
    assert got == {(i, j) for i in range(5) for j in range(5) if km(pts[i], pts[j]) <= 3.0} and (0, 1) in got and (2, 3) in got
    assert near.within(a, b, 30_000.0, "id", "other", leaf_targets=1).count() == 25


def test_regions_with_a_hole_and_shared_borders(spark):
    ring = lambda name, xy: [(name, *map(float, (*xy[i], *xy[(i + 1) % len(xy)]))) for i in range(len(xy))]
    big, hole, tri = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)], [(4, 0), (8, 0), (4, 4)]
    e = ring("ring", big) + ring("ring", hole) + ring("tri", tri)
    edges = spark.createDataFrame(e + [("bad", None, 0.0, 1.0, 1.0)], "n string, x1 double, y1 double, x2 double, y2 double").select(F.struct("n").alias("region"), "x1", "y1", "x2", "y2")
    r = random.Random(2)
    pts = [(i, r.uniform(-1, 9), r.uniform(-1, 5)) for i in range(500)] + [(500, 0.0, 0.0), (501, 4.0, 1.0), (502, 1.0, 1.0), (503, None, 1.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")

    def inside(x, y):
        out = set()
        if 0 <= x < 4 and 0 <= y < 4 and not (1 <= x < 3 and 1 <= y < 3):
            out.add("ring")
        if 4 <= x < 8 and 0 <= y < 8 - x:
            out.add("tri")
        return out

    got = {(x["id"], x["region"]["n"]) for x in near.containing(df, edges, "id", task_rows=40).collect()}
    assert got == {(i, n) for i, x, y in pts if x is not None for n in inside(x, y)}
    assert near.containing(df.filter("id < 0"), edges, "id").count() == 0 == near.containing(df, edges.filter("x1 > 99"), "id").count()


def test_local_tree_with_ties():
    p = np.zeros((100, 3))
    out = []
    near.query_tree(near.build_tree(p), p, p[:5], 0.1, np.arange(5), out)
    assert sum(len(a) for a, _ in out) == 500


def test_nearest_neighbours_keep_colocated(spark):
    s = spark.createDataFrame([("a", 39.0, 0.0), ("b", 39.0, 0.0), ("c", 39.1, 0.0), ("d", 45.0, 9.0)], "station_id string, lat double, lon double")
    got = {(r["station_id"], r["neighbour_rank"]): r["neighbour_id"] for r in spatial.nearest_neighbours(s, k=2).collect()}
    assert got[("a", 1)] == "b" and got[("a", 2)] == "c" and got[("d", 1)] == "c" and len(got) == 8
    assert {(r[0], r[1]) for r in spatial.radius_neighbours(s).collect()} == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}


def test_distance_to_line(spark):
    s = spark.createDataFrame([(39.5, 0.0), (39.5, 1.5), (None, 0.0), (41.0, 1.0)], "lat double, lon double")
    segments = [(1.0, 39.0, 1.0, 40.0), (1.0, 40.0, 1.0, 40.0)]
    k = spatial.KM_PER_DEGREE
    got = [r[0] for r in s.select(spatial.distance_to_line_km("lat", "lon", segments)).collect()]
    assert got[2] is None and [round(x, 6) for x in got[:2] + got[3:]] == [round(k * math.cos(math.radians(39.5)), 6), round(k * math.cos(math.radians(39.5)) / 2, 6), round(k, 6)]
    assert s.select(spatial.distance_to_line_km("lat", "lon", [])).first()[0] is None


def test_closed_regions_of_any_shape_against_exact_arithmetic(spark):
    from fractions import Fraction

    shapes = {"bow": [(0, 0), (3, 2), (3, 0), (0, 2)], "star": [(5, 0), (6, 3), (9, 3), (6.5, 4.5), (7.5, 8), (5, 5.5), (2.5, 8), (3.5, 4.5), (1, 3), (4, 3)], "far": [(-2, 60), (-1, 60), (-1.5, 61)]}
    rows = [(n, *map(float, (*xy[i], *xy[(i + 1) % len(xy)]))) for n, xy in shapes.items() for i in range(len(xy))]
    edges = spark.createDataFrame(rows, "n string, x1 double, y1 double, x2 double, y2 double").select(F.struct("n").alias("region"), "x1", "y1", "x2", "y2")
    pts = [(x / 4, y / 4) for x in range(-4, 40) for y in range(-4, 40)] + [(-1.5, 60.5), (-1.5, 61.0), (-1.75, 60.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lon double, lat double")

    def holds(name, x, y, closed):
        x, y, inside = Fraction(x), Fraction(y), False
        for n, *e in rows:
            if n != name:
                continue
            a, b, c, d = map(Fraction, e)
            if closed and (c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
                return True
            if min(a, c) <= x < max(a, c) and b + (x - a) * (d - b) / (c - a) <= y:
                inside = not inside
        return inside

    for closed in (False, True):
        got = {(r["id"], r["region"]["n"]) for r in near.containing(df, edges, "id", task_rows=7, closed=closed).collect()}
        assert got == {(i, n) for i, p in enumerate(pts) for n in shapes if holds(n, *p, closed)}


def test_crowded_places_give_bounded_parts(spark):
    q = spark.createDataFrame([(i, 39.5, 0.0) for i in range(60)], "q int, lat double, lon double")
    t = spark.createDataFrame([(i, 39.5, 0.0) for i in range(90)] + [(90, 39.6, 0.0), (91, None, 0.0)], "t int, lat double, lon double")
    got = near.within(q, t, 1.0, "q", "t", leaf_targets=8, task_targets=20, task_pairs=300).collect()
    assert sorted((r["q"], r["t"]) for r in got) == [(i, j) for i in range(60) for j in range(90)]
