"""Problem 5 on made cases, and stuck runs against brute force."""

import random

from pluvion.operators import spikes

COLS = ["precip_raw_mm", "temp_raw_c", "wind_gust_raw", "pressure_raw_hpa"]
SCHEMA = "ingest_order bigint, station_id string, t_ms bigint, precip_raw_mm double, temp_raw_c double, wind_gust_raw double, pressure_raw_hpa double, field string, reason string, bad string"


def frame(spark, temps, station="a", field="temp_raw_c"):
    rows = [(i, station, t * 600_000, *[v if c == field else None for c in COLS], "x", "y", "z") for i, (t, v) in enumerate(temps)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, values, field="temp_raw_c", start=0):
    df = frame(spark, list(enumerate(values, start)), field=field)
    return {(r["ingest_order"], r["reason"]) for r in spikes.implausible(df).collect()}


def noisy(n, seed=1, base=15.0):
    r = random.Random(seed)
    return [round(base + r.gauss(0, 0.4), 2) + i * 1e-4 for i, i in enumerate(range(n))]


def test_spikes_and_changes_that_persist(spark):
    v = noisy(1200)
    for i in (50, 300, 301, 302):
        v[i] += 12
    v[1007] = -3.0  # the last reading of a period (of 4032 from the first)
    v[1008] = -3.5
    for i in range(600, 720):
        v[i] += 9  # persists
    v[900], v[901] = 99.9, -45.6
    assert found(spark, v, start=3024) == {(50, "spike"), (300, "spike"), (301, "spike"), (302, "spike"), (1007, "spike"), (1008, "spike"), (900, "impossible"), (901, "impossible")}


def test_showers_build_up(spark):
    r, v = random.Random(4), [0.0] * 300
    while len(v) < 9000:  # the gauge's ordinary rain: short bursts and showers that swell and ebb
        v += [0.0] * r.randint(20, 60) + [0.2 * (1 + int(r.expovariate(1 / 1.5)))] + [0.0] * r.randint(20, 60)
        top = r.expovariate(1 / 4)
        v += [round(5 * top * x) / 5 for x in (0.1, 0.4, 0.8, 1.0, 0.7, 0.3, 0.1)]
    v[100:108] = [0.2, 1.4, 5.0, 9.0, 14.0, 9.5, 3.0, 0.4]
    v[120:126] = [0.6, 17.0, 1.2, 16.0, 0.8, 0.2]
    v[140] = 9.0
    v[200] = 40.0
    v[220:223] = [0.6, 90.0, 0.8]
    assert found(spark, v, "precip_raw_mm") == {(200, "spike"), (221, "spike")}


def test_stuck_over_borders_and_exempt_values(spark):
    r = random.Random(3)
    v = [r.choice([14.0, 14.1, 14.2, 14.2, 14.2]) for _ in range(2200)]
    v[1003:1013] = [14.5] * 10  # over the border of a period
    want = set()
    i = 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] == v[i]:
            j += 1
        if j - i >= 8:
            want |= {(k, "stuck") for k in range(i, j)}
        i = j
    assert found(spark, v, start=3024) == want and (1005, "stuck") in want
    assert found(spark, [0.0] * 50, "wind_gust_raw") == set() == found(spark, [0.4] * 50, "precip_raw_mm")
    assert len(found(spark, [5.0] * 8, "precip_raw_mm")) == 8 and found(spark, [5.0] * 7, "precip_raw_mm") == set()


def test_resent_rows_are_judged_by_their_own_value(spark):
    v = noisy(200)
    rows = [(i, x) for i, x in enumerate(v)] + [(100, 60.0), (100, 40.0), (100, v[100])]
    got = {(r["ingest_order"], r["reason"]) for r in spikes.implausible(frame(spark, rows)).collect()}
    assert got == {(200, "impossible"), (201, "spike")}


def test_nulls_and_empty(spark):
    assert spikes.implausible(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 0, 300.0, None, None, None, "", "", ""), (2, "a", None, 300.0, None, None, None, "", "", ""), (3, "a", 0, float("nan"), float("inf"), None, -1.0, "", "", "")]
    got = {(r["ingest_order"], r["field"]) for r in spikes.implausible(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, "temp_raw_c"), (3, "pressure_raw_hpa")}
