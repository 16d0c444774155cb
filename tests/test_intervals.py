"""Problem 4 against brute force on minutes."""

import random
from datetime import datetime, timedelta

from pluvion.operators import intervals

SCHEMA = "station_id string, timestamp_utc timestamp_ntz, delta_prev_min bigint, kind string, month string"


def brute(rows):
    groups = {}
    for s, t, d, *_ in rows:
        if s is None or t is None or d is None or d <= 0:
            continue
        e = int((t - datetime(1970, 1, 1)).total_seconds() // 60)
        groups.setdefault((s, t.year, t.month), []).append((e - d, e))
    out = set()
    for (s, *_), iv in groups.items():
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(s, "covered", a, b) for a, b in merged} | {(s, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    r = intervals.covered_and_gaps(intervals.qc_intervals(df)).select("station_id", "kind", "start_min", "end_min").collect()
    assert len(set(r)) == len(r)
    return {tuple(x) for x in r}


def test_random(spark):
    r = random.Random(5)
    t0 = datetime(2025, 10, 30, 22)
    rows = [(r.choice(["hot", "hot", "b", None]), t0 + timedelta(minutes=r.randrange(6000), seconds=r.randrange(60)), r.choice([5, 10, 10, 30, 200, 3000, 0, -5, None]), "x", "y") for _ in range(250)]
    rows += rows[:40] + [("b", None, 5, "x", "y")]
    assert got(spark, rows) == brute(rows)


def test_touching_nested_and_month_border(spark):
    d = datetime(2025, 11, 1, 0, 20)
    rows = [("a", d, 30, "", ""), ("a", d + timedelta(minutes=10), 10, "", ""), ("a", d + timedelta(minutes=60), 5, "", ""), ("a", d - timedelta(minutes=25), 10, "", ""), ("a", d, 5, "", "")]
    e = int((d - datetime(1970, 1, 1)).total_seconds() // 60)
    assert got(spark, rows) == {("a", "covered", e - 30, e + 10), ("a", "gap", e + 10, e + 55), ("a", "covered", e + 55, e + 60), ("a", "covered", e - 35, e - 25)}
    assert got(spark, []) == set()
