"""Problem 6: points near other points (k-d partitions with halo copies) and regions holding points (plane sweep)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.session import cut

EARTH_KM = 6371.0


def unit_vectors(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add x, y, z on the unit sphere; rows without a place on it (NULL, NaN, infinite, latitude beyond 90) are left out."""
    a, b = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    ok = F.col(lat).between(-90, 90) & (F.abs(F.col(lon)) < 1e6)  # NaN is above every number
    return df.filter(ok).withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def fit_splits(points: DataFrame, depth: int) -> np.ndarray:
    """Medians of a k-d tree of the given depth over x, y, z (axis = level mod 3), in heap order; one aggregation a level.

    Node i has the children 2i + 1 and 2i + 2.  Splits steer the partitioning only; they need not be exact.  At most
    2^depth numbers come to the driver.
    """
    splits = np.zeros(2**depth - 1)
    for level in range(depth):
        axis = "xyz"[level % 3]
        rows = points.withColumn("__leaf", leaf_of(splits, level)("x", "y", "z")).groupBy("__leaf").agg(F.percentile_approx(axis, 0.5, 1000).alias("m")).collect()
        for r in rows:
            splits[2**level - 1 + r["__leaf"]] = r["m"]
    return splits


def leaf_of(splits: np.ndarray, depth: int):
    """Column function: number of the leaf (0 ... 2^depth - 1) that holds a vector."""

    @F.pandas_udf("int")
    def leaf(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        at, v = np.zeros(len(x), dtype=np.int64), np.column_stack([x, y, z])
        for level in range(depth):
            at = 2 * at + (v[:, level % 3] >= splits[2**level - 1 + at])
        return pd.Series(at.astype(np.int32))

    return leaf


def leaves_near(splits: np.ndarray, depth: int, chord: float):
    """Column function: every leaf that a ball of radius ``chord`` around a vector touches (its own and its halo)."""

    @F.pandas_udf("array<int>")
    def leaves(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        v = np.column_stack([x, y, z])
        row, at = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            gap = v[row, level % 3] - splits[2**level - 1 + at]
            left, right = gap < chord, gap >= -chord
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
        order = np.argsort(row, kind="stable")
        return pd.Series(np.split(at[order].astype(np.int32), np.searchsorted(row[order], np.arange(1, len(x)))) if len(x) else [])

    return leaves


def build_tree(points: np.ndarray, index: np.ndarray | None = None, level: int = 0, small: int = 16):
    """k-d tree of a partition's points: (axis, split, left, right), or an array of point numbers at a leaf."""
    index = np.arange(len(points)) if index is None else index
    if len(index) <= small or level > 60:
        return index
    axis = level % 3
    split = float(np.median(points[index, axis]))
    low = points[index, axis] < split
    if low.all() or not low.any():  # ties: try the other axes, then stop
        spread = np.ptp(points[index], axis=0)
        if not spread.any():
            return index
        return build_tree(points, index, level + 1, small)
    return axis, split, build_tree(points, index[low], level + 1, small), build_tree(points, index[~low], level + 1, small)


def query_tree(node, points: np.ndarray, asked: np.ndarray, chord: float, which: np.ndarray, out: list, chunk: int = 2_000_000) -> None:
    """Append (question numbers, point numbers) within ``chord`` of each other; whole batches of questions descend together."""
    if not len(which):
        return
    if isinstance(node, tuple):
        axis, split, left, right = node
        v = asked[which, axis]
        query_tree(left, points, asked, chord, which[v < split + chord], out)
        query_tree(right, points, asked, chord, which[v >= split - chord], out)
        return
    step = max(1, chunk // max(1, len(node)))
    for i in range(0, len(which), step):
        w = which[i : i + step]
        d2 = ((asked[w][:, None, :] - points[node][None, :, :]) ** 2).sum(axis=2)
        q, p = np.nonzero(d2 <= chord * chord)
        out.append((w[q], node[p]))


def within(questions: DataFrame, targets: DataFrame, radius_km: float, question_id: str, target_id: str, lat: str = "lat", lon: str = "lon", leaf_targets: int = 128, task_rows: int = 100_000, task_targets: int = 4_000, task_pairs: int = 20_000_000, max_depth: int = 12) -> DataFrame:
    """(``question_id``, ``target_id``, distance_km): each pair at most ``radius_km`` apart by great circle.

    Both sides become unit vectors.  Space is cut by k-d splits fitted to the targets; a target is copied to every leaf
    within the chord of the radius, a question goes to its own leaf only.  A leaf is dealt out in a grid of parts: its
    targets to columns of about ``task_targets`` (more than one only where many share a place), its questions to rows of
    at most ``task_rows``, so that no part can give more than about ``task_pairs`` pairs; questions are copied to each
    column and targets to each row.  Each part builds a local k-d tree.

    Defined results: rows without a position give nothing, NULL ids are kept as values, repeated rows give repeated
    pairs, equal positions are at distance 0, empty sides give no rows, other columns are ignored.
    """
    chord = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    xyz = ["x", "y", "z"]
    asked = unit_vectors(questions.select(F.struct(F.col(question_id).alias("v")).alias("__q"), F.col(lat).alias("__la"), F.col(lon).alias("__lo")), "__la", "__lo").select("__q", *xyz)
    there = unit_vectors(targets.select(F.struct(F.col(target_id).alias("v")).alias("__t"), F.col(lat).alias("__la"), F.col(lon).alias("__lo")), "__la", "__lo").select("__t", *xyz)
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1, there.count()) / leaf_targets))))
    splits = fit_splits(there, depth)
    asked = asked.withColumn("leaf", leaf_of(splits, depth)(*xyz))
    there = there.withColumn("leaf", F.explode(leaves_near(splits, depth, chord)(*xyz)))
    n, m = (np.zeros(2**depth, dtype=np.int64) for _ in range(2))
    for counts, side in ((n, asked), (m, there)):
        for r in side.groupBy("leaf").count().collect():  # at most 2^depth rows
            counts[r["leaf"]] = r["count"]
    columns = np.maximum(1, -(-m // task_targets))
    rows = np.maximum(1, -(-n // np.maximum(1, np.minimum(task_rows, task_pairs // np.clip(m, 1, task_targets)))))
    of_leaf = lambda numbers: F.get(F.array(*[F.lit(int(k)).cast("bigint") for k in numbers]), F.col("leaf"))
    every = lambda numbers: F.explode(F.sequence(F.lit(0).cast("bigint"), of_leaf(numbers) - 1))
    asked = asked.withColumn("row", F.pmod(F.xxhash64("__q", *xyz), of_leaf(rows))).withColumn("column", every(columns))
    there = there.withColumn("column", F.pmod(F.xxhash64("__t", *xyz), of_leaf(columns))).withColumn("row", every(rows))
    kinds = dict(asked.dtypes) | dict(there.dtypes)

    def join(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        v, w = q[xyz].to_numpy(), t[xyz].to_numpy()
        found: list = []
        if len(v) and len(w):
            query_tree(build_tree(w), w, v, chord, np.arange(len(v)), found)
        a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        d = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(((v[a] - w[b]) ** 2).sum(axis=1)) / 2)) if len(a) else np.zeros(0)
        near = d <= radius_km + 1e-9
        return pd.DataFrame({"q": q["__q"].to_numpy()[a[near]], "t": t["__t"].to_numpy()[b[near]], "distance_km": d[near]})

    out = asked.groupBy("leaf", "row", "column").cogroup(there.groupBy("leaf", "row", "column")).applyInPandas(join, f"q {kinds['__q']}, t {kinds['__t']}, distance_km double")
    return out.select(F.col("q.v").alias(question_id), F.col("t.v").alias(target_id + "_near" if target_id == question_id else target_id), "distance_km")


def cell_edges(cells: DataFrame, half: float = 0.05, keys: tuple[str, ...] = ("lon_idx", "lat_idx")) -> DataFrame:
    """Edges (region, x1, y1, x2, y2) of square cells around their centres; corners are rounded so that neighbours share them."""
    a, b = F.round(F.col("lon") - half, 6), F.round(F.col("lon") + half, 6)
    c, d = F.round(F.col("lat") - half, 6), F.round(F.col("lat") + half, 6)
    edge = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return cells.select(F.struct(*keys).alias("region"), F.inline(F.array(edge(a, c, b, c), edge(b, c, b, d), edge(b, d, a, d), edge(a, d, a, c))))


def sweep(x: np.ndarray, y: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, region: np.ndarray, closed: bool = False, chunk: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(point numbers, region numbers): a vertical line sweeps from left to right with a set of active edges; a point is
    inside a region if an odd number of the region's active edges lies at or below it.  Edges run left to right, x1 <= x2,
    and are active from x1 up to but without x2; ``closed`` adds the points on an edge.

    Between two ends of edges the set is the same.  Only strips with points are looked at; from one to the next the edges
    that end are dropped and those that begin are added.
    """
    points, regions = [np.zeros(0, int)], [np.zeros(0, int)]
    line = np.flatnonzero(x1 < x2)
    line = line[np.argsort(x1[line], kind="stable")]
    stops = np.unique(np.concatenate([x1[line], x2[line]]))
    order = np.argsort(x, kind="stable")
    strip = np.searchsorted(stops, x[order], side="right")
    ends = np.flatnonzero(np.diff(strip, append=-1) != 0) + 1
    active, added = np.zeros(0, int), 0
    for i, j in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()) if len(order) else []:
        if not 0 < strip[i] < len(stops):
            continue
        at = stops[strip[i] - 1]
        upto = int(np.searchsorted(x1[line], at, side="right"))
        new = line[added:upto]
        active, added = np.concatenate([active[x2[active] > at], new[x2[new] > at]]), upto
        if not len(active):
            continue
        active = active[np.argsort(region[active], kind="stable")]
        names, first = np.unique(region[active], return_index=True)
        slope = (y2[active] - y1[active]) / (x2[active] - x1[active])
        for k in range(i, j, step := max(1, chunk // len(active))):
            p = order[k : min(j, k + step)]
            below = y1[active] + slope * (x[p][:, None] - x1[active]) <= y[p][:, None]
            a, b = np.nonzero(np.add.reduceat(below, first, axis=1) % 2)
            points.append(p[a])
            regions.append(names[b])
    if not closed or not len(x1) or not len(x):
        return np.concatenate(points), np.concatenate(regions)
    # points on edges, ends and vertical edges included: again from left to right, by edges in groups of nearby points
    by_x = x[order]
    lo, hi = np.searchsorted(by_x, x1, "left"), np.searchsorted(by_x, x2, "right")
    for e in np.flatnonzero(hi > lo).tolist():
        p = order[lo[e] : hi[e]]
        across = (x2[e] - x1[e]) * (y[p] - y1[e]) - (y2[e] - y1[e]) * (x[p] - x1[e])
        on = p[(np.abs(across) <= 1e-12) & (y[p] >= min(y1[e], y2[e])) & (y[p] <= max(y1[e], y2[e]))]
        points.append(on)
        regions.append(np.full(len(on), region[e]))
    both = np.unique(np.column_stack([np.concatenate(points), np.concatenate(regions)]), axis=0)
    return both[:, 0], both[:, 1]


def containing(points: DataFrame, edges: DataFrame, point_id: str, lat: str = "lat", lon: str = "lon", tile_deg: float = 0.5, task_rows: int = 200_000, closed: bool = False) -> DataFrame:
    """(``point_id``, region): the regions that hold each point, by even-odd rule, so that holes count as outside.

    Left and lower borders belong to a region; with ``closed`` all borders and corners do.  The plane is cut into tiles;
    a point goes to one, an edge to every tile that it crosses from west to east, between its region's south and north
    ends.  Tiles with many points are salted.  Each part sweeps its edges.  Points without position and edges with a NULL
    or NaN end give nothing, repeated points give repeated rows, empty sides give no rows.  The counts of the tiles that
    hold points, at most (1080 / ``tile_deg``) (180 / ``tile_deg``) rows, are sent to all tasks.
    """
    tile = lambda c: F.floor(F.col(c) / tile_deg).cast("int")
    p = points.select(F.struct(F.col(point_id).alias("v")).alias("__p"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")).filter("abs(x) <= 540 AND abs(y) <= 90").withColumns({"slab": tile("x"), "band": tile("y")})
    ends = {"x1": F.least("x1", "x2"), "y1": F.when(F.col("x1") <= F.col("x2"), F.col("y1")).otherwise(F.col("y2")), "x2": F.greatest("x1", "x2"), "y2": F.when(F.col("x1") <= F.col("x2"), F.col("y2")).otherwise(F.col("y1"))}
    e = edges.filter("abs(x1) <= 540 AND abs(x2) <= 540 AND abs(y1) <= 90 AND abs(y2) <= 90").select(F.to_json("region").alias("region"), *[c.alias(k) for k, c in ends.items()])
    extent = e.groupBy("region").agg(F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"))
    e = e.join(extent, "region").withColumn("slab", F.explode(F.sequence(tile("x1"), tile("x2")))).withColumn("band", F.explode(F.sequence(tile("south"), tile("north")))).drop("south", "north")
    tiles = F.broadcast(cut(p.groupBy("slab", "band").agg(F.expr(f"cast(ceil(count(*) / {task_rows}) AS bigint)").alias("parts"))))
    p = p.join(tiles, ["slab", "band"]).withColumn("part", F.pmod(F.xxhash64("__p", "x", "y"), F.col("parts"))).drop("parts")
    e = e.join(tiles, ["slab", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    region = edges.schema["region"].dataType.simpleString()
    kind = dict(p.dtypes)["__p"]

    def join(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(t["region"].to_numpy(dtype=object), return_inverse=True)
        a, b = sweep(q["x"].to_numpy(), q["y"].to_numpy(), *(t[c].to_numpy() for c in ("x1", "y1", "x2", "y2")), number, closed) if len(q) and len(t) else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"p": q["__p"].to_numpy()[a], "region": names[b]})

    by = ("slab", "band", "part")
    out = p.groupBy(*by).cogroup(e.groupBy(*by)).applyInPandas(join, f"p {kind}, region string")
    return out.select(F.col("p.v").alias(point_id), F.from_json("region", region).alias("region"))
