"""Problem 3: irregular readings onto a regular grid, gaps imputed by iterative singular-spectrum analysis."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MIN = 1440


def bucketed(df: DataFrame, value: str = "precip_raw_mm", taken_ms: str = "t_ms", order: str = "ingest_order", slot_min: int = 30) -> DataFrame:
    """(station_id, slot_start_min, value, readings): per slot the sum over its readings, each reading once.

    A reading is a row with station, instant and a value that is neither NULL nor NaN.  Of rows with the same station
    and instant the one with the highest order counts (of equal ones the larger value).
    """
    rows = df.select("station_id", F.col(taken_ms).alias("t"), F.coalesce(F.col(order), F.lit(-1)).alias("o"), F.col(value).cast("double").alias("v"))
    rows = rows.filter("station_id IS NOT NULL AND t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    latest = rows.groupBy("station_id", "t").agg(F.max(F.struct("o", "v")).alias("last"))
    slot = F.expr(f"floor(t / {slot_min * 60_000}) * {slot_min}").cast("bigint")
    return latest.groupBy("station_id", slot.alias("slot_start_min")).agg(F.sum("last.v").alias("value"), F.count("*").alias("readings"))


def day_grid(slots: DataFrame, slot_min: int = 30) -> DataFrame:
    """Every slot of every UTC day on which the station has a slot with readings; ``readings`` 0 and NULL value where none."""
    rows = slots.withColumn("day", F.expr(f"floor(slot_start_min / {DAY_MIN})").cast("bigint"))
    days = rows.groupBy("station_id", "day").agg(F.collect_list(F.struct("slot_start_min", "value", "readings")).alias("__have"))  # at most a day's slots
    grid = F.transform(F.sequence(F.lit(0), F.lit(DAY_MIN - slot_min), F.lit(slot_min)), lambda k: F.col("day") * DAY_MIN + k)
    known = F.map_from_entries(F.transform("__have", lambda s: F.struct(s["slot_start_min"], F.struct(s["value"], s["readings"]))))
    cell = days.select("station_id", "day", known.alias("__known"), F.explode(grid).alias("slot_start_min")).withColumn("__x", F.try_element_at("__known", F.col("slot_start_min")))
    return cell.select("station_id", "day", "slot_start_min", F.col("__x.value").alias("value"), F.coalesce("__x.readings", F.lit(0).cast("bigint")).alias("readings"))


def ssa_fill(x: np.ndarray, window: int = 48, rank: int = 6, rounds: int = 1000, tolerance: float = 1e-3) -> np.ndarray:
    """The filled series of ``ssa_settle``."""
    return ssa_settle(x, window, rank, rounds, tolerance)[0]


def ssa_settle(x: np.ndarray, window: int = 48, rank: int = 6, rounds: int = 1000, tolerance: float = 1e-3) -> tuple[np.ndarray, bool]:
    """Fill the NaNs of one bounded series: embed in a Hankel matrix, truncate its singular vectors, average the
    diagonals, put the result in the missing places, repeat until no place moves by more than ``tolerance`` of the series'
    deviation.  The second value tells whether they settled within ``rounds``.  A series without gaps comes back as it is."""
    gaps = np.isnan(x)
    if not gaps.any():
        return x, True
    n, filled = len(x), np.where(gaps, np.nanmean(x), x)
    window = min(window, n // 2)
    if window < 2 or np.ptp(filled) == 0:
        return filled, True
    at = np.arange(window)[:, None] + np.arange(n - window + 1)[None, :]
    weight = np.bincount(at.ravel(), minlength=n)
    scale = float(np.nanstd(x)) or 1.0
    for _ in range(rounds):
        hankel = filled[at]
        _, vectors = np.linalg.eigh(hankel @ hankel.T)  # left singular vectors, ascending
        lead = vectors[:, -min(rank, window) :]
        smooth = np.bincount(at.ravel(), (lead @ (lead.T @ hankel)).ravel(), minlength=n) / weight
        moved = float(np.abs(smooth[gaps] - filled[gaps]).max())
        filled[gaps] = smooth[gaps]
        if moved <= tolerance * scale:
            return filled, True
    return filled, False


def regular_series(slots: DataFrame, slot_min: int = 30, block_days: int = 14, rank: int = 6, floor: float | None = 0.0) -> DataFrame:
    """(station_id, slot_start_min, value, readings, filled, settled): a regular series on the station's days, gaps filled and marked.

    ``settled`` is false for the filled slots of a block whose values still moved after the last round.

    Blocks of ``block_days`` days of one station are imputed apart from each other; a block holds at most
    ``block_days * 1440 / slot_min`` slots however many readings fall into them, so no task grows with a station.
    Days without any reading are no rows, but empty places in their block.  Filled values below ``floor`` become it.
    An empty input gives an empty result; a block always holds a reading, so every filled value is a number.
    """
    width = block_days * DAY_MIN // slot_min

    def impute(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        at = ((block["slot_start_min"] - key[1] * block_days * DAY_MIN) // slot_min).to_numpy()
        series = np.full(width, np.nan)
        series[at] = block["value"].to_numpy(dtype=float)
        lo, hi = at.min(), at.max() + 1
        done, settled = ssa_settle(series[lo:hi].copy(), window=DAY_MIN // slot_min, rank=rank)
        done = done[at - lo]
        gap = (block["readings"] == 0).to_numpy()
        if floor is not None:
            done = np.where(gap, np.maximum(done, floor), done)
        return pd.DataFrame({"station_id": block["station_id"], "slot_start_min": block["slot_start_min"], "value": done, "readings": block["readings"], "filled": gap, "settled": settled | ~gap})

    cells = day_grid(slots, slot_min).withColumn("block", F.expr(f"floor(day / {block_days})").cast("bigint"))
    return cells.groupBy("station_id", "block").applyInPandas(impute, "station_id string, slot_start_min bigint, value double, readings bigint, filled boolean, settled boolean")
