"""Spatial operators: interpolation, nearest cells, polygons, neighbour graphs and autocorrelation.

Coordinates are plain doubles in metres (or degrees where stated). Distance joins are equi-joins on grid
cells as wide as the radius, with the neighbouring cells exploded on one side, so they never compare all
pairs of points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.operators.cells import BLOCK, _numbers, finite, nearest_rows, sums_within
from cohorta.sources.io import kept

# The settings by station density.
#: (power, max distance, min and max neighbours) by station density: above 5, above 2, else, per km².
ADAPTIVE_FINE = ((5.0, (2.5, 15_000.0, 4, 8)), (2.0, (2.0, 25_000.0, 3, 10)), (None, (1.5, 50_000.0, 2, 15)))
ADAPTIVE_COARSE = ((5.0, (1.2, 20_000.0, 3, 6)), (2.0, (1.0, 30_000.0, 3, 8)), (None, (0.8, 60_000.0, 2, 12)))
#: Tested local Moran statistics: numbers of neighbours whose sums are kept in a row, and points that meet such rows in a task, about.
BAND, MET = 64, 20_000


def grid(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, step: float) -> DataFrame:
    """(ix, iy, x, y) of a regular grid, half-open at the far bounds."""
    nx, ny = (max(0, int(np.ceil((b - a) / step))) for a, b in ((x0, x1), (y0, y1)))
    cells = spark.range(nx * ny)
    ix, iy = F.pmod(F.col("id"), F.lit(max(nx, 1))), F.floor(F.col("id") / max(nx, 1))
    return cells.select(ix.cast("long").alias("ix"), iy.cast("long").alias("iy"), (F.lit(x0) + ix * step).alias("x"), (F.lit(y0) + iy * step).alias("y"))


def near_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows at most ``radius`` apart, with ``distance``; ``on`` columns must also agree. Column names of the sides differ but for ``on``."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.withColumns({"_cx": cell(lx), "_cy": cell(ly)})
    b = right.withColumn("_cx", F.explode(F.array(*[cell(rx) + i for i in (-1, 0, 1)]))).withColumn("_cy", F.explode(F.array(*[cell(ry) + i for i in (-1, 0, 1)])))
    gap = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return a.join(b, ["_cx", "_cy", *on]).withColumn("distance", gap).where(F.col("distance") <= radius).drop("_cx", "_cy")


def idw(targets: DataFrame, stations: DataFrame, target_keys: Sequence[str], value: str, radius: float, power: float = 2.0, smoothing: float = 0.0, least: int = 3, most: int = 12, on: Sequence[str] = ()) -> DataFrame:
    """Inverse distance weighting of each target (x, y) from the nearest ``most`` stations (sx, sy, value) within ``radius``;
    NULL with fewer than ``least``. A target on a station takes its value where smoothing is 0."""
    keys = [*target_keys, *on]
    ranked = nearest_rows(targets.select(*keys, "x", "y"), stations.where(F.col(value).isNotNull()).select("sx", "sy", value, *on), target_keys, most, radius, on)
    d = F.col("distance") + smoothing
    w = F.when(d > 0, 1 / F.pow(d, F.lit(power)))
    exact = F.max(F.when(d == 0, F.col(value)))
    some = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_neighbors"), F.coalesce(exact, F.sum(w * F.col(value)) / F.sum(w)).alias("estimate"))
    out = targets.join(some, keys, "left")
    return out.withColumns({"n_neighbors": F.coalesce("n_neighbors", F.lit(0)), "estimate": F.when(F.col("n_neighbors") >= least, F.col("estimate"))})


def adaptive_parameters(stations: DataFrame, day: str, area_km2: float, levels=ADAPTIVE_FINE) -> DataFrame:
    """Density of each day's stations and the interpolation parameters that it calls for."""
    n = stations.groupBy(day).agg(F.count(F.lit(1)).alias("n_stations")).withColumn("density", F.col("n_stations") / F.lit(area_km2))
    out = {}
    for i, name in enumerate(("power", "max_distance", "min_neighbors", "max_neighbors")):
        col = F.lit(levels[-1][1][i])
        for above, values in reversed(levels[:-1]):
            col = F.when(F.col("density") > above, F.lit(values[i])).otherwise(col)
        out[name] = col
    return n.withColumns(out)


def idw_adaptive(targets: DataFrame, stations: DataFrame, target_keys: Sequence[str], day: str, value: str, area_km2: float, smoothing: float = 10.0, levels=ADAPTIVE_FINE, least_stations: int = 2, low: float = -25.0, high: float = 60.0) -> DataFrame:
    """Interpolation of every day's stations on all targets with that day's own parameters, clipped; days with too few stations are left out."""
    p = adaptive_parameters(stations, day, area_km2, levels).where(F.col("n_stations") >= least_stations)
    widest = max(v[1] for _, v in levels)
    met = near_join(targets, stations.join(F.broadcast(p), day), "x", "y", "sx", "sy", widest).where(F.col("distance") <= F.col("max_distance"))
    keys = [*target_keys, day]
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "sx", "sy"))).where(F.col("_r") <= F.col("max_neighbors"))
    w = 1 / F.pow(F.col("distance") + smoothing, F.col("power"))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_neighbors"), F.first("min_neighbors").alias("_least"), (F.sum(w * F.col(value)) / F.sum(w)).alias("estimate"))
    e = F.least(F.greatest("estimate", F.lit(low)), F.lit(high))
    return out.select(*keys, "n_neighbors", F.when(F.col("n_neighbors") >= F.col("_least"), e).alias("estimate"))


def idw_cross_validation(stations: DataFrame, key: str, value: str, folds: int = 5, radius: float = 25_000.0, power: float = 2.0, least: int = 3, most: int = 12) -> DataFrame:
    """Mean absolute error by fold, each estimated from the other folds' stations; the fold is the id modulo ``folds``."""
    s = stations.withColumn("fold", F.pmod(F.col(key), F.lit(folds)))
    test = s.select(F.col(key).alias("target"), F.col("fold"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col(value).alias("truth"))
    train = s.select(F.col("fold").alias("train_fold"), "sx", "sy", value)
    ranked = nearest_rows(test, train, ["target"], most, radius, apart=("fold", "train_fold"))
    w = F.when(F.col("distance") > 0, 1 / F.pow("distance", F.lit(power)))
    est = ranked.groupBy("target", "fold", "truth").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("distance") == 0, F.col(value))), F.sum(w * F.col(value)) / F.sum(w)).alias("e")).where(F.col("n") >= least)
    return est.groupBy("fold").agg(F.avg(F.abs(F.col("e") - F.col("truth"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def gaussian_smooth(cells: DataFrame, ix: str, iy: str, value: str, sigma: float, on: Sequence[str] = ()) -> DataFrame:
    """Gaussian filter of grid values cut at four sigmas, of the valid cells only; two passes, one for each axis."""
    reach = int(4 * sigma + 0.5)
    w = [float(np.exp(-0.5 * (d / sigma) ** 2)) for d in range(-reach, reach + 1)]

    def axis(df: DataFrame, along: str, across: str) -> DataFrame:
        spread = df.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        k = F.element_at(F.array(*[F.lit(x) for x in w]), F.col("_d") + reach + 1)
        return spread.groupBy(*on, (F.col(along) + F.col("_d")).alias(along), across).agg((F.sum(k * F.col("_v")) / F.sum(k)).alias("_v"))

    valid = cells.where(F.col(value).isNotNull()).select(*on, ix, iy, F.col(value).cast("double").alias("_v"))
    once = axis(valid, ix, iy).join(valid.select(*on, ix, iy), [*on, ix, iy])
    return axis(once.select(*on, ix, iy, "_v"), iy, ix).join(valid.select(*on, ix, iy), [*on, ix, iy]).withColumnRenamed("_v", value)


def _delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles of a Delaunay triangulation (Bowyer-Watson)."""
    span = max(np.ptp(x), np.ptp(y), 1.0) * 20
    px, py = np.append(x, [x.mean() - span, x.mean() + span, x.mean()]), np.append(y, [y.mean() - span, y.mean() - span, y.mean() + span])
    n, tri = len(x), {(len(x), len(x) + 1, len(x) + 2)}

    def inside(t: tuple[int, int, int], i: int) -> bool:
        a = np.array([[px[j] - px[i], py[j] - py[i], (px[j] - px[i]) ** 2 + (py[j] - py[i]) ** 2] for j in t])
        turn = (px[t[1]] - px[t[0]]) * (py[t[2]] - py[t[0]]) - (px[t[2]] - px[t[0]]) * (py[t[1]] - py[t[0]])
        return np.linalg.det(a) * np.sign(turn) > 0

    for i in range(n):
        bad = [t for t in tri if inside(t, i)]
        edges = [tuple(sorted(e)) for t in bad for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        tri -= set(bad)
        tri |= {(*e, i) for e in edges if edges.count(e) == 1}
    return np.array([t for t in tri if max(t) < n], dtype=int).reshape(-1, 3)


def linear_interpolation(targets: DataFrame, stations: DataFrame, day: str, value: str, least: int = 3) -> DataFrame:
    """By day: linear on the stations' triangles, the nearest station outside of them. One day's stations and targets meet in one task."""

    def run(key: tuple, pts: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        st = st.dropna(subset=[value])
        if len(st) < least or not len(pts):
            return pd.DataFrame({day: [], "x": [], "y": [], "estimate": []})
        st = st.groupby(["sx", "sy"], as_index=False)[value].mean()
        sx, sy, v = st["sx"].to_numpy(), st["sy"].to_numpy(), st[value].to_numpy()
        qx, qy = pts["x"].to_numpy(), pts["y"].to_numpy()
        out = v[((qx[:, None] - sx) ** 2 + (qy[:, None] - sy) ** 2).argmin(axis=1)].astype(float)
        for a, b, c in _delaunay(sx, sy) if len(st) >= 3 else []:
            den = (sy[b] - sy[c]) * (sx[a] - sx[c]) + (sx[c] - sx[b]) * (sy[a] - sy[c])
            if abs(den) < 1e-12:
                continue
            u = ((sy[b] - sy[c]) * (qx - sx[c]) + (sx[c] - sx[b]) * (qy - sy[c])) / den
            w = ((sy[c] - sy[a]) * (qx - sx[c]) + (sx[a] - sx[c]) * (qy - sy[c])) / den
            hit = (u >= -1e-12) & (w >= -1e-12) & (u + w <= 1 + 1e-12)
            out[hit] = u[hit] * v[a] + w[hit] * v[b] + (1 - u[hit] - w[hit]) * v[c]
        return pd.DataFrame({day: key[0], "x": qx, "y": qy, "estimate": out})

    kind = stations.schema[day].dataType.simpleString()
    days = targets.select("x", "y").crossJoin(F.broadcast(stations.select(F.col(day).alias("_day")).distinct()))
    return days.groupBy("_day").cogroup(stations.select(day, "sx", "sy", F.col(value).cast("double").alias(value)).groupBy(day)).applyInPandas(run, f"{day} {kind}, x double, y double, estimate double")


def ring_contains(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Ray casting against one ring, as an expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            crossings = crossings + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - F.lit(y1)) + F.lit(x1))).cast("int")
    return crossings % 2 == 1


def inside_polygon(points: DataFrame, x: str, y: str, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Points in any ring; each ring's bounding box is tested first, which a scan can push down."""
    found = F.lit(False)
    for ring in rings:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
        found = found | (box & ring_contains(F.col(x), F.col(y), ring))
    return points.where(found)


def bounding_box(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float) -> DataFrame:
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def nearest_cell(points: DataFrame, cells: DataFrame, x: str, y: str, x0: float, y0: float, step: float, nx: int, ny: int) -> DataFrame:
    """Points with the value of their cell of a regular grid (ix, iy); outside of its hull NULL. The cell is computed, so this is an equi-join."""
    ix, iy = F.round((F.col(x) - x0) / step).cast("long"), F.round((F.col(y) - y0) / step).cast("long")
    inside = F.col(x).between(x0, x0 + (nx - 1) * step) & F.col(y).between(y0, y0 + (ny - 1) * step)
    return points.withColumns({"ix": F.when(inside, ix), "iy": F.when(inside, iy)}).join(cells, ["ix", "iy"], "left")


def nearest(left: DataFrame, right: DataFrame, key: str, axes: Sequence[tuple[str, str]], gap: Column, chosen: Sequence[Column], radius: float, furthest: float) -> DataFrame:
    """(key, best): for each row of ``left`` the smallest struct of distance (``gap``) and ``chosen`` among all rows of ``right``.

    Rows meet where their cells on ``axes`` (pairs of column names, at most two, no distance above ``gap``) are neighbours.
    What lies farther than ``radius`` can't meet so, hence only a best within it is final; the others go on with twice the
    radius, up to ``furthest``. So each round is an equi-join, and few rows are left for the wide ones.
    """
    todo, found = left, []
    while True:
        cell = lambda c, r=radius: F.floor(F.col(c) / r).cast("long")
        a, b, on = todo, right, []
        for i, (l, r) in enumerate(axes):
            a = a.withColumn(f"_n{i}", cell(l))
            b = b.withColumn(f"_n{i}", F.explode(F.array(*[cell(r) + k for k in (-1, 0, 1)])))
            on.append(f"_n{i}")
        met = a.join(b, on).groupBy(key).agg(F.min(F.struct(gap.alias("d"), *chosen)).alias("best"))
        last = radius >= furthest
        found.append(kept(met if last else met.where(F.col("best.d") <= radius * (1 - 1e-9)), "nearest"))
        todo = todo.join(found[-1].select(key), key, "left_anti")
        if last or todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        radius *= 2


def nearest_fill(points: DataFrame, sites: DataFrame, key: str, value: str, radius: float | None = None, require_value: bool = True) -> DataFrame:
    """Points (x, y) whose value is NULL take that of the nearest site (sx, sy), within ``radius`` if one is given, of those with a value if that is required."""
    s = sites.select("sx", "sy", F.col(value).alias("_v"))
    s = s.where(F.col("_v").isNotNull()) if require_value else s
    empty = points.where(F.col(value).isNull()).select(key, "x", "y")
    if radius is not None:
        one = s.groupBy("sx", "sy").agg(F.min(F.struct("_v")).alias("best"))
        best = nearest_rows(empty, one, [key], 1, radius).select(key, "best")
    else:
        sides = points.select("x", "y").union(s.select("sx", "sy")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        wide = max((sides[1] or 0) - (sides[0] or 0), (sides[3] or 0) - (sides[2] or 0), 1e-9)
        gap = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
        best = nearest(empty, s, key, [("x", "sx"), ("y", "sy")], gap, ["sx", "sy", "_v"], 2 * wide / max(1.0, s.count() ** 0.5), 2 * wide)
    best = best.select(key, F.col("best._v").alias("_fill"))
    return points.join(best, key, "left").withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")


def distance_band(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """(i, j, w): neighbours at most ``radius`` apart, without oneself, weights of each i summing to 1."""
    a = points.select(F.col(key).alias("i"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    b = points.select(F.col(key).alias("j"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    met = near_join(a, b, "_x1", "_y1", "_x2", "_y2", radius).where("i != j").select("i", "j")
    degree = met.groupBy("i").agg((1 / F.count(F.lit(1))).alias("w"))
    return met.join(degree, "i")


class Band:
    """The weights of :func:`distance_band`, told by their points and radius instead of listed.

    Lags and Moran statistics of these points then need no pairs: neighbours are summed where they meet. The pairs are
    listed where keys repeat, or where the statistics are of other points.
    """

    def __init__(self, points: DataFrame, key: str, x: str, y: str, radius: float) -> None:
        self.points, self.key, self.x, self.y, self.radius = points, key, x, y, radius

    def links(self) -> DataFrame:
        return distance_band(self.points, self.key, self.x, self.y, self.radius)

    def summable(self, points: DataFrame, key: str) -> bool:
        return points is self.points and key == self.key and points.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()

    def lag(self, z: DataFrame) -> DataFrame:
        """(key, z, lag, degree) of (key, z, x, y): rows without a key or with coordinates that are not finite have no neighbours."""
        key = F.col(self.key)
        here = z.where(key.isNotNull() & finite("_x", "_y"))
        places = here.groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("s"))
        around = places.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "c", F.col("s").alias("_same")).join(sums_within(places, self.radius).select(F.col("x").alias("_x"), F.col("y").alias("_y"), "n", "s"), ["_x", "_y"], "left")
        degree = F.when(key.isNotNull(), F.coalesce("n", F.lit(0)) + F.col("c") - 1)
        total = F.coalesce("s", F.lit(0.0)) + F.when(F.col("c") > 1, F.col("_same") - F.coalesce("z", F.lit(0.0))).otherwise(0.0)
        out = z.join(around, ["_x", "_y"], "left").withColumn("degree", F.coalesce(degree, F.lit(0)))
        return out.select(self.key, "z", F.when(F.col("degree") > 0, total / F.col("degree")).otherwise(0.0).alias("lag"), "degree")


def _lag(points: DataFrame, weights: Band, key: str, value: str) -> DataFrame:
    mean = points.agg(F.avg(value)).first()[0]
    at = [F.col(c).cast("double").alias(n) for c, n in ((weights.x, "_x"), (weights.y, "_y"))]
    return weights.lag(points.select(F.col(key), (F.col(value) - F.lit(mean)).alias("z"), *at))


def spatial_lag(points: DataFrame, weights: DataFrame | Band, key: str, value: str) -> DataFrame:
    """(key, z, lag): centred value and the weighted mean of the neighbours' (0 without neighbours)."""
    if isinstance(weights, Band):
        if weights.summable(points, key):
            return _lag(points, weights, key, value).select(key, "z", "lag")
        weights = weights.links()
    mean = points.agg(F.avg(value)).first()[0]
    z = points.select(F.col(key), (F.col(value) - F.lit(mean)).alias("z"))
    lag = weights.join(z.select(F.col(key).alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    return z.join(lag.withColumnRenamed("i", key), key, "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def moran_global(points: DataFrame, weights: DataFrame | Band, key: str, value: str) -> DataFrame:
    """(moran_i, expected, n): NULL for a constant value."""
    if isinstance(weights, Band) and weights.summable(points, key):
        lag, s0 = _lag(points, weights, key, value), F.count_if(F.col("degree") > 0)
    else:
        weights = weights.links() if isinstance(weights, Band) else weights
        lag, s0 = spatial_lag(points, weights, key, value), F.lit(weights.agg(F.sum("w")).first()[0])
    s = lag.agg(F.sum(F.col("z") * F.col("lag")).alias("a"), F.sum(F.col("z") * F.col("z")).alias("b"), F.count(F.lit(1)).alias("n"), s0.cast("double").alias("s0"))
    i = F.try_divide(F.try_divide(F.col("n"), F.col("s0")) * F.col("a"), F.col("b"))
    return s.select(i.alias("moran_i"), F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("expected"), "n")


def moran_permutations(points: DataFrame, weights: DataFrame, key: str, value: str, rounds: int = 99, seed: int = 1) -> DataFrame:
    """(p, mean, sd, z): pseudo-significance from keyed reshuffles of the values over the points, all in one plan."""
    observed = moran_global(points, weights, key, value).first()["moran_i"]
    perms = points.select(F.col(key), F.col(value)).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    place = Window.partitionBy("perm").orderBy(key)
    drawn = Window.partitionBy("perm").orderBy(F.xxhash64(F.lit(seed), "perm", key), key)
    a = perms.select("perm", F.row_number().over(place).alias("r"), key)
    mean = points.agg(F.avg(value)).first()[0]
    b = perms.select("perm", F.row_number().over(drawn).alias("r"), (F.col(value) - F.lit(mean)).alias("z"))
    z = a.join(b, ["perm", "r"]).select("perm", key, "z")
    lag = weights.join(z.select("perm", F.col(key).alias("j"), F.col("z").alias("zj")), "j").groupBy("perm", "i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    s0 = weights.agg(F.sum("w")).first()[0]
    n = points.count()
    each = z.join(lag.withColumnRenamed("i", key), ["perm", key], "left").groupBy("perm").agg((F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))) / F.sum(F.col("z") * F.col("z")) * F.lit(n / s0)).alias("m"))
    s = each.agg(F.count_if(F.col("m") >= F.lit(observed)).alias("k"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    tail = F.least(F.col("k"), F.lit(rounds) - F.col("k"))
    return s.select(((tail + 1) / F.lit(rounds + 1.0)).alias("p"), "mean", "sd", F.try_divide(F.lit(observed) - F.col("mean"), F.col("sd")).alias("z"))


def moran_local(points: DataFrame, weights: DataFrame | Band, key: str, value: str) -> DataFrame:
    """(key, local_i, quadrant): 1 high among high, 2 low among high, 3 low among low, 4 high among low."""
    lag = spatial_lag(points, weights, key, value)
    return _quadrants(kept(lag, "lag") if isinstance(weights, Band) else lag, key)


def _quadrants(lag: DataFrame, key: str) -> DataFrame:
    m2 = lag.agg(F.avg(F.col("z") * F.col("z"))).first()[0]
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), 1).when((F.col("z") <= 0) & (F.col("lag") > 0), 2).when((F.col("z") <= 0) & (F.col("lag") <= 0), 3).otherwise(4)
    return lag.select(key, F.try_divide(F.col("z") * F.col("lag"), F.lit(m2)).alias("local_i"), quadrant.alias("quadrant"))


def _passes(z: np.ndarray, lag: np.ndarray, mean: np.ndarray, slack: float) -> np.ndarray:
    """Whether drawn means give at least the observed statistic. Equal sums may differ by rounding."""
    return z * mean >= z * lag - slack


def _front(table: pa.Table, key: str, most: int, slack: float) -> pa.Table:
    """Of one round, told by its points with the smallest hashes: (band, c) of the sums of its first values, BAND by BAND, and
    (key, above) of the points that a draw without themselves counts otherwise; no rows where it is too short."""
    z, lag, degree, h = _numbers(table, "z", "lag", "degree", "h")
    schema = pa.schema([("band", pa.int64()), ("c", pa.list_(pa.float64())), (key, table.schema.field(key).type), ("above", pa.int64())])
    if len(z) <= most:
        return schema.empty_table()
    order = np.lexsort((z, h))[: most + 1]
    z, lag, degree = z[order], lag[order], degree[order]
    c = np.append(0.0, np.cumsum(z))
    own = np.flatnonzero(degree > np.arange(most + 1))
    k = degree[own]
    at = z[own], lag[own]
    change = _passes(*at, (c[k + 1] - at[0]) / k, slack).astype(np.int64) - _passes(*at, c[k] / k, slack)
    bands = [c[i : min(i + BAND, most + 1)] for i in range(0, most + 1, BAND)]
    keys = table[key].combine_chunks().take(pa.array(order[own[change != 0]]))
    sums = pa.table([np.arange(len(bands)), bands, pa.nulls(len(bands), keys.type), pa.nulls(len(bands), pa.int64())], schema=schema)
    return pa.concat_tables([sums, pa.table([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), schema.field("c").type), keys, change[change != 0]], schema=schema)])


def _count(points: pa.Table, sums: pa.Table, key: str, slack: float) -> pa.Table:
    """(key, above): how many rounds pass for each point, of a band's sums of all rounds."""
    z, lag, degree = _numbers(points, "z", "lag", "degree")
    above = np.zeros(len(z), np.int64)
    if len(z):
        c = np.asarray(sums["c"].combine_chunks().flatten()).reshape(len(sums), -1)
        order = np.argsort(degree, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(degree[order])) + 1):
            mean = c[:, degree[some[0]] % BAND] / degree[some[0]]
            for part in np.array_split(some, -(-len(some) * len(mean) // BLOCK)):
                above[part] = _passes(z[part, None], lag[part, None], mean, slack).sum(axis=1)
    return pa.table({key: points[key], "above": above})


def _tested(lag: DataFrame, key: str, rounds: int, seed: int) -> DataFrame:
    """(key, p) of (key, z, lag, degree): a round is one order of all points by a keyed hash, and a point with k neighbours draws the
    first k others of it. So all draws are sums from the front of a round, and only as much of it is sorted as the most neighbours need.

    Points with as many neighbours meet the same sums, so these go to their points and no row is made for a point and round. A
    point that is itself in its draw is passed over for the next; what that changes is told where the round is sorted.
    """
    n, most, m2 = lag.agg(F.count(F.lit(1)), F.max("degree"), F.avg(F.col("z") * F.col("z"))).first()
    most, slack, kind = most or 0, 1e-9 * (m2 or 0.0), lag.schema[key].dataType
    spread = lag.select(key, F.coalesce("z", F.lit(0.0)).alias("z"), "lag", F.col("degree").cast("long").alias("degree"))
    # All points go to each group of rounds, which makes its hashes there: only a few copies of the points are shuffled.
    groups = min(rounds, 2 * lag.sparkSession.sparkContext.defaultParallelism)
    copies = spread.withColumn("group", F.explode(F.sequence(F.lit(1), F.lit(groups)))).repartitionByRange(groups, "group")
    hashed = copies.withColumn("round", F.explode(F.sequence(F.col("group"), F.lit(rounds), F.lit(groups)))).withColumn("h", F.xxhash64(F.lit(seed), "round", key))
    made = T.StructType([T.StructField("band", T.LongType()), T.StructField("c", T.ArrayType(T.DoubleType())), T.StructField(key, kind), T.StructField("above", T.LongType())])
    share = (most + 6 * most**0.5 + 40) / max(n, 1)
    while True:
        front = hashed if share >= 1 else hashed.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
        drawn = kept(front.groupBy("group", "round").applyInArrow(lambda t: _front(t, key, most, slack), made), "drawn")
        if share >= 1 or drawn.where("band = 0").count() == rounds:
            break
        share *= 2
    points = spread.where("degree > 0").withColumn("band", F.floor(F.col("degree") / BAND))
    # Bands with more than MET points, at most one for each MET points, are dealt out in slices.
    slices = F.broadcast(points.groupBy("band").count().where(F.col("count") > MET).select("band", F.ceil(F.col("count") / MET).alias("_n")))
    dealt = points.join(slices, "band", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64(key), "_n"), F.lit(0))).drop("_n")
    sums = drawn.where(F.col("band").isNotNull()).select("band", "c").join(slices, "band", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    met = T.StructType([T.StructField(key, kind), T.StructField("above", T.LongType())])
    counts = dealt.groupBy("band", "slice").cogroup(sums.groupBy("band", "slice")).applyInArrow(lambda a, b: _count(a, b, key, slack), met)
    above = F.sum("above")
    p = (F.least(above, F.lit(rounds) - above) + 1) / F.lit(rounds + 1.0)
    return counts.union(drawn.where(F.col("band").isNull()).select(key, "above")).groupBy(key).agg(p.alias("p"))


def _significant(tested: DataFrame, level: float) -> DataFrame:
    return tested.withColumn("p", F.when(F.col("local_i").isNotNull(), F.col("p"))).withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def moran_local_tested(points: DataFrame, weights: DataFrame | Band, key: str, value: str, rounds: int = 999, seed: int = 1, level: float = 0.05) -> DataFrame:
    """As :func:`moran_local`, with ``p`` and ``significant``: neighbours' values are drawn anew, by a keyed hash, from all other points.
    The least ``p`` is 1 / (rounds + 1), so with 19 rounds or fewer none is below 0.05. NULL without neighbours or without a statistic.

    With a band, a round draws without replacement and in one order for all points (as esda does), so no pair is listed. With
    listed weights each round gives every neighbour of a point the value at a hashed place among the points, so a round is
    a join by number, not a reshuffle of the table.
    """
    if isinstance(weights, Band):
        if weights.summable(points, key):
            lag = kept(_lag(points, weights, key, value), "lag")
            return _significant(_quadrants(lag, key).join(_tested(lag, key, rounds, seed), key, "left"), level)
        weights = weights.links()
    local = moran_local(points, weights, key, value)
    lag = spatial_lag(points, weights, key, value)
    cut = lag.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    before = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = kept(cut.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(F.broadcast(before), "_p").select(key, "z", "lag", (F.col("_i") + F.col("_o") - 1).alias("at")), "numbered")
    n = numbered.count()
    drawn = weights.select("i", "j", "w").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "round", "i", "j"), F.lit(max(n, 1))))
    sums = drawn.join(numbered.select("at", F.col("z").alias("zr")), "at").groupBy("i", "round").agg(F.sum(F.col("w") * F.col("zr")).alias("lr"))
    own = numbered.select(F.col(key).alias("i"), "z", "lag")
    count = sums.join(own, "i").groupBy("i").agg(F.count_if(F.col("z") * F.col("lr") >= F.col("z") * F.col("lag")).alias("k"))
    p = (F.least(F.col("k"), F.lit(rounds) - F.col("k")) + 1) / F.lit(rounds + 1.0)
    return _significant(local.join(count.select(F.col("i").alias(key), p.alias("p")), key, "left"), level)


def strongest_cluster(df: DataFrame, cluster: str, z: str) -> DataFrame:
    """(cluster, z): the cluster whose statistic is largest without its sign, the smallest label of equals."""
    return df.where(F.col(z).isNotNull()).orderBy(F.abs(z).desc(), cluster).limit(1).select(cluster, z)


def moran_slope(points: DataFrame, weights: DataFrame | Band, key: str, value: str) -> DataFrame:
    """(slope, r) of the spatial lag on the value."""
    return spatial_lag(points, weights, key, value).agg(F.regr_slope("lag", "z").alias("slope"), F.corr("lag", "z").alias("r"))
