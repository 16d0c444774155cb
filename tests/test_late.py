"""Problem 2 against brute force; the counters' algebra."""

import random

from pluvion.operators import late

SCHEMA = "station_id string, t_ms bigint, n_ms bigint, ingest_order bigint, precip_raw_mm double, version string"


def random_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = r.randrange(0, 6 * 60) * 60_000
        rows.append((r.choice(["hot", "hot", "b", None]), r.choice([t, t, t, None]), t + r.choice([0, 60_000, 600_000, 4_200_000, 90_000_000, 200_000_000]), i, r.choice([0.0, 0.2, 1.5, None, float("nan")]), "x"))
    return rows


def brute(rows):
    def state(cut):
        best = {}
        for s, t, n, o, v, _ in rows:
            if s is None or t is None or n is None or v is None or v != v:
                continue
            h = t // 3_600_000 * 60
            if n <= (h + 60 + cut) * 60_000:
                k = (s, h, t)
                best[k] = max(best.get(k, (n, o, v)), (n, o, v))
        out = {}
        for (s, h, _), (_, _, v) in best.items():
            a, b = out.get((s, h), (0, 0.0))
            out[(s, h)] = (a + 1, b + v)
        return out

    a, b = state(10), state(1440)
    return {k for k in a.keys() | b.keys() if (x := a.get(k, (0, 0.0)))[0] != (y := b.get(k, (0, 0.0)))[0] or round(abs(x[1] - y[1]), 6) > 0.05}


def test_corrected_periods(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["station_id"], r["period_start_min"]) for r in late.corrected_periods(late.late_counters(df)).collect()}
    assert got == brute(rows) and got


def test_merge_is_idempotent_and_order_free(spark):
    rows = random_rows(2)
    random.Random(3).shuffle(rows)
    a, b = late.late_counters(spark.createDataFrame(rows[:250], SCHEMA)), late.late_counters(spark.createDataFrame(rows[150:], SCHEMA))
    whole = sorted(map(tuple, late.late_counters(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sorted(map(tuple, late.merge_counters(a, b, a).collect())) == whole == sorted(map(tuple, late.merge_counters(b, a).collect()))


def test_cutoffs_are_inclusive_and_empty_table(spark):
    end = 60 * 60_000
    rows = [("a", 0, end + 600_000, 1, 1.0, "x"), ("b", 0, end + 600_001, 2, 1.0, "x"), ("c", 0, end + 86_400_000, 3, 1.0, "x"), ("d", 0, end + 86_400_001, 4, 1.0, "x")]
    got = {r[0] for r in late.corrected_periods(late.late_counters(spark.createDataFrame(rows, SCHEMA))).select("station_id").collect()}
    assert got == {"b", "c"}
    assert late.corrected_periods(late.late_counters(spark.createDataFrame([], SCHEMA))).count() == 0
