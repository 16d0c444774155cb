"""Problem 7 against numpy."""

import random

import numpy as np
import pytest

from pluvion.llm import percentiles as pc

QS = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]


def rows(seed, n=700):
    r = random.Random(seed)
    out = [(r.choice(["hot", "hot", "b", None]), r.choice([0.0, -0.0, 0.2, 0.2, -7.5, r.gauss(0, 1e3), r.gauss(0, 1e-300), 5e-324, 1e308, None, float("nan"), float("inf")]), 1) for _ in range(n)]
    return out + [("one", 4.5, 1), ("none", None, 1)]


def quantile(v, q):
    """Linear between ranks, the infinite one beside a finite one."""
    low, high = (float(np.quantile(v, q, method=m)) for m in ("lower", "higher"))
    return low if low == high else high if np.isinf(high) else float(np.quantile(v[np.isfinite(v)], q * (len(v) - 1) / (np.isfinite(v).sum() - 1)))


def test_exact(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "g string, v double, n int")
    got = {(r["g"], r["q"]): (r["value"], r["n"]) for r in pc.exact_percentiles(df, ["g"], "v", QS).collect()}
    for g in ["hot", "b", None, "one"]:
        v = np.array([x for k, x, _ in data if k == g and x is not None and not np.isnan(x)])
        for q in QS:
            assert got[(g, q)][1] == len(v)
            assert got[(g, q)][0] == pytest.approx(quantile(v, q), rel=1e-12, abs=1e-320)  # infinite values at the upper end
    assert len(got) == 4 * len(QS)


def test_days_combine_within_bounds(spark):
    data = rows(2)
    df = spark.createDataFrame([(g, i % 5, v) for i, (g, v, _) in enumerate(data)], "g string, day int, v double")
    days = pc.digit_histogram(pc.keyed(df, ["g", "day"], "v"), ["g", "day"]).drop("day")
    parts = [days.filter("key % 2 = 0"), days.filter("key % 2 <> 0")]
    both = pc.merge_counts(*parts, group=["g"])
    again = pc.merge_counts(parts[1], parts[0], group=["g"])
    assert sorted(map(str, both.collect())) == sorted(map(str, again.collect()))
    for r in pc.percentiles(both, ["g"], QS, digits=2).collect():
        v = np.array([x for k, x, _ in data if k == r["g"] and x is not None and not np.isnan(x)])
        want = quantile(v, r["q"])
        if np.isinf(want):
            assert r["high"] == want
            continue
        slack = 1e-9 * abs(want) + 1e-320
        assert r["low"] - slack <= want <= r["high"] + slack
        if abs(want) > 1e-290 and r["q"] * (len(v) - 1) % 1 == 0:
            assert abs(r["high"] - r["low"]) <= abs(want) * 2.0**-19


def test_empty(spark):
    assert pc.exact_percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", QS).count() == 0
