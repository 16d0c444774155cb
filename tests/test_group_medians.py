"""Medians of a group and of its other stations by rank, and the baseline's area is one grid cell."""

import random
from statistics import median

import __spark_entry__ as entry
from pluvion.operators import verify


def test_by_rank(spark):
    r = random.Random(5)
    rows = [(f"s{i:02}", g, float(r.randint(0, 4))) for g in range(1, 9) for i in range(g)]
    got = verify.group_medians(spark.createDataFrame(rows, "station_id string, area int, accum_mm double"), ["area"]).collect()
    assert len(got) == len(rows)
    for x in got:
        others = [v for s, g, v in rows if g == x["area"] and s != x["station_id"]]
        assert (x["stations"], x["area_median"]) == (x["area"], median([v for _, g, v in rows if g == x["area"]]))
        assert x["loo_median"] == (median(others) if others else None)


def test_registered_per_cell(spark, sf):
    assert {"cell_medians_by_cell", "areal_baseline_by_cell", "fig_ets_four_curves"} <= set(entry.queries())
