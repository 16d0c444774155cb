"""Problem 3: the grid, the marks and the imputation."""

import numpy as np

from pluvion.operators import regular

SCHEMA = "station_id string, t_ms bigint, ingest_order bigint, precip_raw_mm double, slot_start_min string"
HALF = 30 * 60_000


def test_grid_and_marks(spark):
    rows = [("a", 0, 1, 0.4, "x"), ("a", 0, 2, 0.6, "x"), ("a", HALF - 1, 3, 1.0, "x"), ("a", 5 * HALF, 4, None, "x"), ("a", 7 * HALF, 5, float("nan"), "x"), ("a", 48 * HALF * 20, 6, 2.0, "x"), (None, 0, 7, 1.0, "x"), ("b", None, 8, 1.0, "x"), ("n", -1, 9, 3.0, "x")]
    got = regular.regular_series(regular.bucketed(spark.createDataFrame(rows, SCHEMA))).toPandas()
    a = got[got.station_id == "a"].set_index("slot_start_min")
    assert len(a) == 96 and (~a.filled).sum() == 2 and a.loc[0, "value"] == 1.6 and a.loc[0, "readings"] == 2
    assert a.value.notna().all() and (a.value >= 0).all() and set(got.station_id) == {"a", "n"}
    n = got[got.station_id == "n"]
    assert n.slot_start_min.min() == -1440 and not n.set_index("slot_start_min").loc[-30, "filled"]
    assert regular.regular_series(regular.bucketed(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ssa_recovers_a_rhythm():
    t = np.arange(480)
    truth = 10 + 5 * np.sin(2 * np.pi * t / 48) + 2 * np.cos(2 * np.pi * t / 24)
    x = truth.copy()
    gaps = np.random.default_rng(0).choice(480, 80, replace=False)
    x[gaps] = np.nan
    x[200:215] = np.nan
    done = regular.ssa_fill(x)
    hole = np.isnan(x)
    assert np.abs(done[hole] - truth[hole]).max() < 0.5 < np.abs(np.nanmean(x) - truth[hole]).max()
    assert (done[~hole] == truth[~hole]).all()


def test_ssa_small_cases():
    assert regular.ssa_fill(np.array([1.0])).tolist() == [1.0]
    assert regular.ssa_fill(np.array([np.nan, 2.0])).tolist() == [2.0, 2.0]
    assert regular.ssa_fill(np.array([0.0, np.nan, 0.0, 0.0])).tolist() == [0.0] * 4


def test_blocks_that_do_not_settle_are_marked():
    x = np.sin(np.arange(200.0))
    x[50:60] = np.nan
    assert regular.ssa_settle(x)[1] and not regular.ssa_settle(x, rounds=1, tolerance=0.0)[1]


def test_hidden_slots_of_a_daily_rhythm_are_recovered(spark):
    """Held-out error: a daily course with noise, a tenth of the readings hidden in runs of up to six slots."""
    r = np.random.default_rng(5)
    t = np.arange(14 * 48)
    truth = 12 + 6 * np.sin(2 * np.pi * t / 48) + r.normal(0, 0.5, len(t))
    hidden = np.zeros(len(t), bool)
    for at in r.choice(len(t) - 6, 22, replace=False):
        hidden[at : at + r.integers(1, 7)] = True
    rows = [("a", int(k) * HALF + 60_000, int(k), float(truth[k]), "x") for k in np.flatnonzero(~hidden)]
    got = regular.regular_series(regular.bucketed(spark.createDataFrame(rows, SCHEMA)), floor=None).toPandas().set_index("slot_start_min").sort_index()
    miss = got["value"].to_numpy()[hidden] - truth[hidden]
    assert got["filled"].to_numpy().tolist() == hidden.tolist() and got["settled"].all()
    assert np.sqrt(np.mean(miss**2)) < 0.9 and np.sqrt(np.mean((truth[~hidden].mean() - truth[hidden]) ** 2)) > 3
