"""The dealt operators on hard tables: NULLs in every column, repeated rows, ties, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from pluvion.operators import intervals, late, near, regular, spikes, stamps
from pluvion.plans import network

CLASHES = "t_ms n_ms clock_zone relay_zone date_order value readings filled day block month start_min end_min leaf part slab x y z v e t n field week hour usual reason cutoff region distance_km __p0 __best __st".split()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def raw(spark, sf):
    return spark.read.parquet(f"{sf}/raw_window.parquet").filter("ingest_order % 2 = 0").cache()


@pytest.fixture(scope="module")
def clocks(spark, sf):
    return spark.read.parquet(f"{sf}/station_clocks.parquet").cache()


@pytest.fixture(scope="module")
def inventory(spark, sf):
    return spark.read.parquet(f"{sf}/avamet_station_inventory_cv.parquet").select("station_id", "lat", "lon").cache()


@pytest.fixture(scope="module")
def operators(clocks, inventory):
    """Each operator from raw_window's rows, with its columns."""
    stamped = lambda df: stamps.normalise_stamps(df, clocks)
    return {
        "stamps": lambda df: stamps.found_stamps(df, clocks),
        "late": lambda df: late.corrected_periods(late.late_counters(stamped(df))).select("station_id", "period_start_min"),
        "regular": lambda df: regular.regular_series(regular.bucketed(stamped(df))),
        "spikes": lambda df: spikes.implausible(stamped(df)),
        "near": lambda df: near.within(df, inventory, 2.0, "ingest_order", "station_id"),
    }


@pytest.mark.parametrize("name", ["stamps", "late", "regular", "spikes", "near"])
def test_clashing_columns_change_nothing(operators, raw, name):
    plain = operators[name](raw)
    have = {c.lower() for c in raw.columns}
    wide = raw.withColumns({c: F.lit("7") for c in CLASHES if c not in have})
    assert rows_of(operators[name](wide), *plain.columns) == rows_of(plain, *plain.columns)


@pytest.mark.parametrize("name", ["stamps", "late", "regular", "spikes", "near"])
def test_nulls_in_every_column(spark, operators, raw, name):
    """A row with a NULL in one column keeps, loses or changes its own results only; no column's NULL is an error."""
    nulls = raw.limit(0)
    for c in raw.columns:
        nulls = nulls.unionByName(raw.limit(3).withColumn(c, F.lit(None).cast(raw.schema[c].dataType)))
    nothing = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in raw.schema])
    out = operators[name](nulls.unionByName(nothing))
    assert out.columns == operators[name](raw).columns
    out.collect()
    assert operators[name](nothing).filter(" OR ".join(f"{c} IS NOT NULL" for c in out.columns)).count() == 0
    assert operators[name](raw.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["late", "regular", "spikes"])
def test_repeated_rows_change_nothing(operators, raw, name):
    once = {r for r in rows_of(operators[name](raw), *operators[name](raw).columns)}
    twice = {r for r in rows_of(operators[name](raw.unionByName(raw)), *operators[name](raw).columns)}
    assert once == twice


def test_stamps_and_places_repeat_with_their_rows(operators, raw):
    for name in ("stamps", "near"):
        once = rows_of(operators[name](raw), *operators[name](raw).columns)
        assert rows_of(operators[name](raw.unionByName(raw)), *operators[name](raw).columns) == sorted(once * 2, key=repr)


def test_extra_columns_survive_stamps(spark, clocks, raw):
    wide = raw.limit(5).withColumns({"clock_zone": F.lit("mine"), "__kept": F.lit(1), "T_MS": F.lit("old")})
    out = stamps.normalise_stamps(wide, clocks)
    assert {"clock_zone", "__kept", "t_ms", "n_ms"} <= set(out.columns) and "T_MS" not in out.columns
    assert {(r["clock_zone"], r["__kept"]) for r in out.collect()} == {("mine", 1)}
    assert dict(out.dtypes)["t_ms"] == "bigint"


def test_very_long_and_odd_stamps(spark, clocks):
    odd = ["9" * 200_000, " " * 50_000 + "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z" * 5_000, "\n", "٢٠٢٤-٠١-٠١T٠٠:٠٠:٠٠Z", "0000-00-00T00:00:00Z", "99999999999999999999"]
    df = spark.createDataFrame([(i, "s", t, t) for i, t in enumerate(odd)], "ingest_order bigint, station_id string, timestamp_utc string, inserted_ts string")
    assert {r["utc_ms"] for r in stamps.found_stamps(df, clocks).collect()} <= {1704067200000}


def test_intervals(spark):
    schema = "station_id string, timestamp_utc timestamp, delta_prev_min bigint, month string, w string, start_min string"
    rows = [("a", None, 5), (None, None, None), ("a", "2024-01-01 00:30:00", None), ("a", "2024-01-01 00:30:00", 0), ("a", "2024-01-01 00:30:00", -9), ("a", "2024-01-01 00:30:59", 10), ("a", "2024-01-01 00:30:59", 10), ("a", "2024-01-01 01:00:00", 10), (None, "2024-01-01 01:00:00", 10)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema.replace("timestamp_utc timestamp", "timestamp_utc string")).withColumn("timestamp_utc", F.to_timestamp("timestamp_utc"))
    base = 28401120  # 2024-01-01 00:00 in minutes
    want = [("a", "covered", base + 20, base + 30), ("a", "covered", base + 50, base + 60), ("a", "gap", base + 30, base + 50)]
    out = intervals.covered_and_gaps(intervals.qc_intervals(df))
    assert rows_of(out, "station_id", "kind", "start_min", "end_min") == want
    assert intervals.covered_and_gaps(intervals.qc_intervals(df.limit(0))).count() == 0


def test_very_long_intervals(spark):
    df = spark.createDataFrame([("a", 2**31 + 5), ("a", 60)], "station_id string, delta_prev_min bigint").withColumn("timestamp_utc", F.to_timestamp(F.lit("2024-01-01 01:00:00")))
    end = 28401180
    assert rows_of(intervals.covered_and_gaps(intervals.qc_intervals(df)), "kind", "start_min", "end_min") == [("covered", end - 2**31 - 5, end)]


def test_regions_with_clashing_columns(spark, sf, raw):
    edges = near.cell_edges(spark.read.parquet(f"{sf}/cv_imerg_grid_cells.parquet"))
    have = {c.lower() for c in raw.columns}
    wide = raw.withColumns({c: F.lit("7") for c in CLASHES if c not in have})
    plain = near.containing(raw, edges, "ingest_order")
    assert rows_of(near.containing(wide, edges, "ingest_order"), *plain.columns) == rows_of(plain, *plain.columns)
    assert near.containing(raw.limit(0), edges, "ingest_order").count() == near.containing(raw, edges.limit(0), "ingest_order").count() == 0


def test_series_and_corrections_match_a_plain_count(spark, sf):
    """p2_found and p3_found against sets of Python, from the instants of all records."""
    recs = [r for r in network.records(spark, sf, "precip_raw_mm").collect() if r["t_ms"] is not None and r["precip_raw_mm"] is not None]
    have = {(r["station_id"], r["t_ms"] // 1_800_000 * 30) for r in recs}
    want = {(s, d * 1440 + 30 * k) for s, d in {(s, m // 1440) for s, m in have} for k in range(48)} - have
    assert {tuple(r) for r in network.p3_found(spark, sf).collect()} == want
    states = []
    for late_min in (10, 1440):
        last = {}
        for r in sorted((r for r in recs if r["n_ms"] is not None), key=lambda r: (r["n_ms"], r["ingest_order"])):
            if r["n_ms"] <= (r["t_ms"] // 3_600_000 * 60 + 60 + late_min) * 60_000:
                last[r["station_id"], r["t_ms"]] = r["precip_raw_mm"]
        hours = {}
        for (s, t), v in last.items():
            n, total = hours.get((s, t // 3_600_000 * 60), (0, 0.0))
            hours[s, t // 3_600_000 * 60] = n + 1, total + v
        states.append(hours)
    differ = {k for k in states[0].keys() | states[1].keys() if (a := states[0].get(k, (0, 0.0)))[0] != (b := states[1].get(k, (0, 0.0)))[0] or round(abs(a[1] - b[1]), 6) > 0.05}
    assert {tuple(r) for r in network.p2_found(spark, sf).collect()} == differ
