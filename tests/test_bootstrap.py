"""The day-block bootstraps against a plain loop with numpy's generator."""

import numpy as np
import pandas as pd
import pytest

from pluvion.operators import verify


def test_counts(spark):
    r = np.random.default_rng(1)
    names = [f"{p}_{k}" for p in ("point", "best") for k in ("tp", "fp", "fn", "tn")]
    table = {(w, d): r.integers(0, 9, 8).tolist() for w in (30, 360) for d in (3, 4, 6, 9)}
    daily = spark.createDataFrame([(w, "fixed", "overlap", d, *c) for (w, d), c in table.items()], "window_min bigint, mode string, stride string, day bigint, " + ", ".join(f"{n} bigint" for n in names))
    days = [2, 3, 4, 5, 6, 7, 9]  # those without a row hold zeros
    got = {x["window_min"]: x for x in verify.bootstrap_counts(daily, spark.createDataFrame([(d,) for d in days + days], "day bigint")).collect()}
    for w in (30, 360):
        counts, rng, samples = np.array([table.get((w, d), [0] * 8) for d in days]), np.random.default_rng(42 + w), []
        for _ in range(1000):
            tp, fp, fn, tn, tp3, fp3, fn3, tn3 = counts[rng.integers(0, 7, size=7)].sum(axis=0)
            samples.append([a / b if b else np.nan for a, b in ((tp, tp + fn), (fp, tp + fp), (tp3, tp3 + fn3), (tp3 + fp3, tp3 + fn3), (2 * (tp3 * tn3 - fn3 * fp3), (tp3 + fn3) * (fn3 + tn3) + (tp3 + fp3) * (fp3 + tn3)))])
        assert (got[w]["blocks"], got[w]["replicates"]) == (7, 1000)
        for k, v in zip(("point_pod", "point_far", "best_pod", "best_bias", "best_hss"), np.array(samples).T):
            assert (got[w][f"{k}_low"], got[w][f"{k}_high"]) == pytest.approx(np.nanquantile(v, [0.025, 0.975]).tolist(), abs=1e-6)


def test_events(spark):
    r, cols = np.random.default_rng(2), ["station_id", "window_min", "end_min", "event_accum_mm", "grid_mm", "grid3x3_mm", "positive_steps", "positive_steps_3x3"]
    rows = []
    for i in range(60):
        p = max(0.0, round(r.normal(4, 5), 2))
        rows.append((f"s{i}", int(r.choice([30, 180])), int(r.integers(0, 9)) * 1440 + i, round(r.uniform(1, 20), 2), p, p + i % 4, int(p > 0), int(p + i % 4 > 0)))
    df = pd.DataFrame(rows, columns=cols)
    got = {(x["scope"], x["metric"]): x for x in verify.bootstrap_events(spark.createDataFrame(df)).collect()}
    assert len(got) == 3 * 8

    def metrics(g):
        a, p, q = g.event_accum_mm, g.grid_mm, g.grid3x3_mm
        return {
            "pod_point": (g.positive_steps > 0).mean(), "pod_3x3": (g.positive_steps_3x3 > 0).mean(), "median_ratio_point": (p / a).median(), "median_ratio_3x3": (q / a).median(), "median_bias_mm_point": (p - a).median(),
            "median_bias_mm_3x3": (q - a).median(), "zero_response_fraction_point": (p <= 0).mean(), "zero_response_fraction_3x3": (q <= 0).mean(),
        }

    for scope, g, seed in (("all", df, 42), ("30", df[df.window_min == 30], 72), ("180", df[df.window_min == 180], 222)):
        blocks, rng = [x for _, x in g.groupby(g.end_min // 1440, sort=True)], np.random.default_rng(seed)
        samples = pd.DataFrame([metrics(pd.concat([blocks[i] for i in rng.integers(0, len(blocks), size=len(blocks))])) for _ in range(1000)])
        for k, v in metrics(g).items():
            x = got[(scope, k)]
            assert (x["events"], x["blocks"], x["replicates"]) == (len(g), len(blocks), 1000)
            assert (x["estimate"], x["low"], x["high"]) == pytest.approx((v, *np.quantile(samples[k], [0.025, 0.975])), abs=1e-6)
