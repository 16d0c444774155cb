"""Problem 5: spikes, stuck values and impossible readings per source.

Readings become seasonal residuals (hour of the day in their four weeks); a reading's excursion is how far it, with at most
two companions, leaves the readings on both sides in the same direction.  Peaks over threshold: per source and quantity
the excesses of the excursions over a high threshold are fitted by a generalised Pareto tail, and the excursion that an
ordinary reading passes with a fixed risk is the cut-off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.session import cut


@dataclass(frozen=True)
class Quantity:
    """What a quantity can be, its resolution, and what counts as stuck."""

    low: float
    high: float
    step: float  #: resolution of the excursions; no scale below half of it is believed
    free_below: float | None = None  #: values below this never count as stuck
    tip: float | None = None  #: rain: only rises count, as a ratio of (value + tip), so that a shower's shoulders weigh
    far: float | None = None  #: further than this from the source's usual value: impossible there, or in another unit


FIELDS = {
    "precip_raw_mm": Quantity(0.0, 200.0, 0.1, free_below=1.0, tip=0.2),
    "temp_raw_c": Quantity(-35.0, 55.0, 0.1, far=30.0),
    "wind_gust_raw": Quantity(0.0, 150.0, 0.1, free_below=1e-9),
    "pressure_raw_hpa": Quantity(650.0, 1090.0, 0.1, far=80.0),
}
#: Share of ordinary readings allowed beyond a cut-off, shape of all tails (heavier than exponential: a source's own
#: excesses are too few to fit it), share of the positive excursions that make the tail, weight of the network's scale.
RISK, SHAPE, TAIL, SHRINK = 1e-6, 0.05, 0.5, 200
RUN = 3
STUCK = 8
PERIOD_MS = 28 * 86_400_000
HOUR_LEAST = 5  #: readings an hour of the day needs in a period for the period to have a daily course


def _bad(q: Quantity, v: np.ndarray) -> np.ndarray:
    return (v < q.low) | (v > q.high)


def _course(q: Quantity, t: np.ndarray, order: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row numbers of the course: one reading an instant, a plausible one before others, then the first received."""
    at = np.lexsort((order, _bad(q, v), t))
    return at[np.concatenate([[True], np.diff(t[at]) > 0])] if len(at) else at


def _daily(q: Quantity, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The period's course by hour of the day, as deviations from its median; zeros where an hour has too few readings."""
    out, hour = np.zeros(24), (t // 3_600_000 % 24).astype(int)
    n = np.bincount(hour, minlength=24)
    if q.tip is None and len(v) and n[n > 0].min() >= HOUR_LEAST:
        s = v[np.lexsort((v, hour))]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        has = n > 0
        out[has] = (s[(first + (n - 1) // 2)[has]] + s[(first + n // 2)[has]]) / 2 - np.median(v)
    return out


def _residual(q: Quantity, t: np.ndarray, v: np.ndarray, daily: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(v, 0.0) / q.tip) if q.tip else v - daily[(t // 3_600_000 % 24).astype(int)]


def _excursions(q: Quantity, t: np.ndarray, r: np.ndarray, course_t: np.ndarray, course_r: np.ndarray) -> np.ndarray:
    """How far each value lies, alone or in a run of up to RUN readings, beyond the readings on both sides of the run.

    ``course_t`` (ascending) and ``course_r`` are the plausible readings around; the value at the same instant is left out.
    """
    pad = np.full(RUN, np.nan)
    c, before, behind = np.concatenate([pad, course_r, pad]), np.searchsorted(course_t, t, "left"), np.searchsorted(course_t, t, "right")
    at = {0: r} | {-i: c[before + RUN - i] for i in range(1, RUN + 1)} | {i: c[behind + RUN + i - 1] for i in range(1, RUN + 1)}
    out = np.zeros(len(t))
    for length in range(1, RUN + 1):
        for first in range(1 - length, 1):
            members = [at[i] for i in range(first, first + length)]
            a, b = at[first - 1], at[first + length]
            out = np.fmax(out, np.minimum.reduce(members) - np.maximum(a, b))  # fmax passes over missing neighbours
            if q.tip is None:
                out = np.fmax(out, np.minimum(a, b) - np.maximum.reduce(members))
    return out


def _sorted(block: pd.DataFrame, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = block[field].to_numpy(dtype=float)
    ok = ~np.isnan(v)
    return block["t"].to_numpy()[ok], block["ingest_order"].to_numpy(dtype=float, na_value=np.inf)[ok], v[ok]


def period_summaries(base: DataFrame, fields: dict[str, Quantity]) -> DataFrame:
    """(station_id, period, field, n, level, bins, counts, first_t, first_v, last_t, last_v) of each source, period and quantity.

    Level is the median, bins and counts the histogram of the period's positive excursions in steps of the resolution;
    first and last hold the readings that the periods beside it need: STUCK + RUN at each end, and RUN plausible ones.
    """
    names, keep = list(fields), STUCK + RUN

    def summary(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for f, q in fields.items():
            t, order, v = _sorted(block, f)
            at = _course(q, t, order, v)
            t, v = t[at], v[at]
            if not len(t):
                continue
            good = np.flatnonzero(~_bad(q, v))
            g, w = t[good], v[good]
            e = _excursions(q, g, r := _residual(q, g, w, _daily(q, g, w)), g, r)
            bins, counts = np.unique(np.rint(e[e > 0] / q.step).astype(np.int64), return_counts=True)
            i, j = np.unique(np.concatenate([np.arange(min(keep, len(t))), good[:RUN]])), np.unique(np.concatenate([np.arange(max(0, len(t) - keep), len(t)), good[-RUN:]]))
            rows.append((*key, f, len(g), float(np.median(w)) if len(w) else None, bins, counts, t[i], v[i], t[j], v[j]))
        return pd.DataFrame(rows, columns=["station_id", "period", "field", "n", "level", "bins", "counts", "first_t", "first_v", "last_t", "last_v"])

    out = "station_id string, period bigint, field string, n bigint, level double, bins array<bigint>, counts array<bigint>, first_t array<bigint>, first_v array<double>, last_t array<bigint>, last_v array<double>"
    return base.select("station_id", "period", "t", "ingest_order", *names).groupBy("station_id", "period").applyInPandas(summary, out)


def fit_tail(bins: np.ndarray, counts: np.ndarray, n: float, step: float, network: float | None = None) -> tuple[float, float, float]:
    """(threshold, scale, share of readings above the threshold) of a histogram of positive excursions.

    The threshold is the lower edge of the bin that holds the (1 - TAIL) quantile.  The scale starts from the median
    excess and becomes the mean of the excesses that a sample of this size would be expected to hold, until it settles,
    so that the spikes themselves do not count; the network's scale weighs as much as SHRINK excesses.
    """
    if not len(bins) or not n:
        return 0.0, max(network or 0.0, step / 2), 0.0
    running = np.cumsum(counts)
    k = int(np.searchsorted(running, running[-1] * (1 - TAIL), side="right"))
    k = min(k, len(bins) - 1)
    u = (bins[k] - 0.5) * step
    y, c = bins[k:] * step - u, counts[k:].astype(float)
    m = c.sum()
    scale = max(float(y[np.searchsorted(np.cumsum(c), m / 2)]) / np.log(2), step / 2)
    scale = scale if network is None else min(scale, 2 * network)
    for _ in range(20):
        inside = y <= scale * np.log(2 * m + 1)
        have = c[inside].sum()
        mean = max(float((y[inside] * c[inside]).sum() / have), step / 2) if have else step / 2
        new = mean if network is None else (have * mean + SHRINK * network) / (have + SHRINK)
        if abs(new - scale) < 1e-4 * step:
            break
        scale = new
    return max(u, 0.0), scale, m / n


def pot_cutoffs(periods: DataFrame, fields: dict[str, Quantity]) -> DataFrame:
    """(station_id, field, usual, threshold, scale, cutoff): each source's fitted tail, and its level (median of its periods').

    The histograms of periods add up; the network's are their sums over all sources, one row a quantity.
    """
    keys = ["station_id", "field"]
    one = periods.select(*keys, F.inline(F.arrays_zip(F.col("bins").alias("bin"), F.col("counts").alias("c"))))
    source = one.groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    packed = lambda rows, by, name: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias(name))
    total = periods.groupBy(*keys).agg(F.sum("n").alias("n"), F.percentile("level", 0.5).alias("usual"))
    network = packed(source.groupBy("field", "bin").agg(F.sum("c").alias("c")), ["field"], "__net").join(total.groupBy("field").agg(F.sum("n").alias("__all")), "field")
    both = total.join(packed(source, keys, "__own"), keys, "left").join(network, "field", "left")

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared: dict[str, float] = {}
        split = lambda h: (np.array([x["bin"] for x in h], dtype=np.int64), np.array([x["c"] for x in h], dtype=np.int64))
        for b in batches:
            rows = []
            for s, f, n, usual, own, net, every in b.itertuples(index=False):
                step = fields[f].step
                if net is not None and f not in shared:
                    shared[f] = fit_tail(*split(net), every, step)[1]
                u, scale, share = fit_tail(*split(own if own is not None else ()), n, step, shared.get(f))
                beyond = scale / SHAPE * (max(share / RISK, 1.0) ** SHAPE - 1)
                rows.append((s, f, usual, u, scale, u + max(beyond, step)))
            yield pd.DataFrame(rows, columns=["station_id", "field", "usual", "threshold", "scale", "cutoff"])

    return both.select(*keys, "n", "usual", "__own", "__net", "__all").mapInPandas(fitted, "station_id string, field string, usual double, threshold double, scale double, cutoff double")


def implausible(df: DataFrame, fields: dict[str, Quantity] = FIELDS, taken_ms: str = "t_ms") -> DataFrame:
    """(ingest_order, field, reason, v, excursion, cutoff): readings that are 'impossible', 'stuck' or a 'spike'.

    A station's course holds one reading an instant.  Every row is judged by its own value against the course around its
    instant.  Rows without a readable instant or station, and NULL or NaN values, are not judged.  A reading with no
    plausible neighbour on one side is no spike.  Infinite values are impossible.  Work is done by source and period of four weeks, so
    that a station with a third of all rows is spread; what a period needs of those around it (a few readings at each
    end) and the source's cut-offs come as one row a period and quantity.  An empty table gives no rows.
    """
    names = list(fields)
    known = F.coalesce(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in names]).isNotNull()
    base = df.filter(f"{taken_ms} IS NOT NULL AND station_id IS NOT NULL").filter(known).select("station_id", F.expr(f"floor({taken_ms} / {PERIOD_MS})").cast("bigint").alias("period"), F.col(taken_ms).cast("bigint").alias("t"), F.col("ingest_order").cast("bigint").alias("ingest_order"), *[F.col(f).cast("double").alias(f) for f in names])
    base = cut(base.repartition("station_id", "period"))  # read twice below, both times as it is partitioned here
    periods = cut(period_summaries(base, fields))
    line = Window.partitionBy("station_id", "field").orderBy("period")
    most, far = STUCK + 2 * RUN, STUCK + RUN
    side = lambda end, rows: F.flatten(F.collect_list(F.arrays_zip(F.col(f"{end}_t").alias("t"), F.col(f"{end}_v").alias("v"))).over(rows))
    around = periods.select("station_id", "period", "field", side("last", line.rowsBetween(-far, -1)).alias("p"), side("first", line.rowsBetween(1, far)).alias("f"))
    halo = F.concat(F.slice("p", F.greatest(F.lit(1), F.size("p") - most + 1), F.lit(most)), F.slice("f", 1, most))
    judged = around.select("station_id", "period", "field", F.transform(halo, lambda x: x["t"]).alias("halo_t"), F.transform(halo, lambda x: x["v"]).alias("halo_v"))
    judged = judged.join(pot_cutoffs(periods, fields), ["station_id", "field"])

    def judge(key: tuple, block: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f, halo_t, halo_v, usual, cutoff in sides[["field", "halo_t", "halo_v", "usual", "cutoff"]].itertuples(index=False):
            q = fields[f]
            t, order, v = _sorted(block, f)
            at = _course(q, t, order, v)
            ct, cv = np.concatenate([t[at], halo_t]).astype(np.int64), np.concatenate([v[at], halo_v])
            own = np.concatenate([np.ones(len(at), bool), np.zeros(len(halo_t), bool)])
            line = np.argsort(ct, kind="stable")
            ct, cv, own = ct[line], cv[line], own[line]
            good, bad = ~_bad(q, cv), _bad(q, v)
            daily = _daily(q, ct[good & own], cv[good & own])
            e = _excursions(q, t, _residual(q, t, v, daily), ct[good], _residual(q, ct[good], cv[good], daily))
            e[bad] = 0.0
            run = np.concatenate([[0], np.cumsum(np.diff(cv) != 0)])
            stuck = np.bincount(run)[run] >= STUCK
            if q.free_below is not None:
                stuck &= cv >= q.free_below
            here = np.searchsorted(ct, t)
            held = stuck[here] & (cv[here] == v)
            odd = bad | (np.abs(v - usual) > q.far if q.far is not None and usual is not None else False)
            reason = np.where(odd, "impossible", np.where(held, "stuck", np.where(e > cutoff, "spike", "")))
            hit = np.flatnonzero(reason != "")
            out.append(pd.DataFrame({"ingest_order": order[hit], "field": f, "reason": reason[hit], "v": v[hit], "excursion": e[hit], "cutoff": cutoff}))
        found = pd.concat(out) if out else pd.DataFrame(columns=["ingest_order", "field", "reason", "v", "excursion", "cutoff"])
        return found.assign(ingest_order=found["ingest_order"].where(np.isfinite(found["ingest_order"].astype(float))).astype("Int64"))

    return base.groupBy("station_id", "period").cogroup(judged.groupBy("station_id", "period")).applyInPandas(judge, "ingest_order bigint, field string, reason string, v double, excursion double, cutoff double")
