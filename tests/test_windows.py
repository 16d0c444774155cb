"""Hand-computed windows, clusters and scores; invariants against brute force."""

import random

from pyspark.sql import functions as F

from pluvion.operators import events, verify, windows

IV = "station_id string, end_min bigint, dur bigint, um double, ud bigint, fails bigint, suspects bigint, intervals bigint, usables bigint, c4 bigint, c5 bigint, c6 bigint, c10 bigint, c15 bigint, c20 bigint, c30 bigint"


def iv(spark, rows):
    full = [("s", e, d, m if ok else 0.0, d if ok else 0, int(f), 0, int(d > 0), int(ok and d > 0), *[int(d == c) for c in (4, 5, 6, 10, 15, 20, 30)]) for e, d, m, ok, f in rows]
    return spark.createDataFrame(full, IV)


def test_left_straddler_and_failures(spark):
    x = iv(spark, [(10, 10, 2.0, True, False), (20, 10, 4.0, True, False), (40, 20, 6.0, True, False)])
    got = {(r["end_min"], r["window_min"]): (r["accum_mm"], round(r["coverage_ratio"], 3)) for r in windows.trailing_windows(x, (25, 30)).collect()}
    assert got[(40, 30)] == (10.0, 1.0) and got[(40, 25)] == (8.0, 1.0) and got[(20, 30)] == (6.0, 0.667)
    y = iv(spark, [(10, 10, 2.0, True, False), (20, 10, 4.0, False, True), (40, 20, 6.0, True, False)])
    r = windows.trailing_windows(y, (30,)).filter("end_min = 40").first()
    assert (r["accum_mm"], r["fail_count"], r["complete_strict"]) == (6.0, 1, False)


def test_bins_share_mass(spark):
    x = iv(spark, [(40, 30, 6.0, True, False)])
    ref = {r["ref_end"]: r["accum_mm"] for r in windows.reference_windows(windows.half_hour_bins(x), (30,)).collect()}
    assert ref == {30: 4.0, 60: 2.0}


def test_windows_over_chunk_borders(spark):
    r = random.Random(4)
    rows, t = [], 1300
    for _ in range(120):
        d = r.choice([5, 10, 30])
        t += d + r.choice([0, 0, 0, 40])
        rows.append((t, d, r.choice([0.0, 0.2, 3.0]), r.random() < 0.9, False))
    got = {(x["end_min"], x["window_min"]): x["accum_mm"] for x in windows.trailing_windows(iv(spark, rows)).collect()}
    for e, *_ in rows:
        for w in windows.WINDOWS:
            want = sum((m if ok else 0) * max(0, b - max(b - d, e - w)) / d for b, d, m, ok, _ in rows if e - w < b <= e)
            assert abs(got[(e, w)] - want) < 1e-5


def test_declustering(spark):
    w = spark.createDataFrame([("s", 60, t, a, 1.0, 0, 0, True) for t, a in ((0, 5.0), (360, 5.0), (721, 4.0))], "station_id string, window_min bigint, end_min bigint, accum_mm double, coverage_ratio double, fail_count bigint, suspect_count bigint, complete_loose boolean")
    thr = spark.createDataFrame([("s", 60, 1.0)], "station_id string, window_min bigint, threshold_mm double")
    got = sorted((r["end_min"], r["cluster_size"]) for r in events.event_catalog(w, thr).collect())
    assert got == [(0, 2), (721, 1)]


def test_scores(spark):
    row = spark.createDataFrame([(3, 1, 2, 4), (0, 0, 0, 5)], "tp bigint, fp bigint, fn bigint, tn bigint")
    a, b = row.select(*[F.expr(e).alias(k) for k, e in verify.scores().items()]).collect()
    assert (a["pod"], a["far"], a["csi"], a["precision"], a["specificity"], a["bias"], a["ets"], a["hss"]) == (0.6, 0.25, 0.5, 0.75, 0.8, 0.8, 0.25, 0.4)
    assert b["pod"] is None and b["ets"] is None and b["hss"] is None and b["specificity"] == 1.0


def test_resampling_matches_numpy(spark):
    import numpy as np

    got = {(r["replicate"], r["block"]): r["times"] for r in verify.resampling(spark, 5, 7, 42).collect()}
    rng = np.random.default_rng(42)
    for i in range(5):
        times = np.bincount(rng.integers(0, 7, size=7), minlength=7)
        assert {b: t for (r, b), t in got.items() if r == i} == {b: t for b, t in enumerate(times.tolist()) if t}


def test_top_per_group_is_exact(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("v"), "id")
    got = {(r["g"], r["rank"]): r["id"] for r in events.top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5).collect()}
    rows = [(i % 3, i * 7919 % 1000, i) for i in range(2000)]
    for g in range(3):
        want = [i for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:5]]
        assert [got[(g, k)] for k in range(1, 6)] == want
