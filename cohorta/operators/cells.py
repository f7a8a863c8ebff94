"""Rows at most a radius apart, met cell by cell in NumPy: each row's nearest, and sums over all within reach.

No pair leaves a task but the nearest that are asked for, so what is shuffled and written grows with the rows, not with
their pairs. A cell is at least as wide as the radius and wide enough for some hundred rows; crowded cells are dealt out
in slices of both sides, whose results are merged, so a task holds two slices at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell on average, at least; and rows of one side that meet in a task, about at most.
FULL, SLICE = 500, 50_000
#: Distances worked out at once.
BLOCK = 2_000_000
#: Sums: fine cells to the radius, at most, and rows in one of them where that allows it.
FINE, ROWS = 20, 12


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.abs(F.col(c)) < F.lit(float("inf")))
    return out


def _width(df: DataFrame, x: str, y: str, least: float) -> float:
    """The smallest of ``least`` times a power of two whose cells have FULL rows on average."""
    widths = [least * 2.0**k for k in range(24)]
    n, *cells = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.struct(F.floor(F.col(x) / w), F.floor(F.col(y) / w))) for w in widths]).first()
    return next((w for w, c in zip(widths, cells) if n >= FULL * c), widths[-1])


def _meet(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``run`` on the rows of ``left`` (x, y) of each cell and all of ``right`` (sx, sy) that may be within the radius, slice by slice."""
    there = lambda df: [df[c].isNotNull() for c in on]
    for test in there(left):
        left = left.where(test)
    for test in there(right):
        right = right.where(test)
    left, right, reach = left.where(finite("x", "y")), right.where(finite("sx", "sy")), radius * (1 + 1e-9)
    w = _width(left, "x", "y", reach)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / w), F.floor((F.col(c) + reach) / w)))
    a = left.withColumns({"_cx": F.floor(F.col("x") / w), "_cy": F.floor(F.col("y") / w)})
    b = right.withColumn("_cx", span("sx")).withColumn("_cy", span("sy"))
    cell = ["_cx", "_cy", *on]
    sizes = a.groupBy(*cell).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*cell).agg(F.count(F.lit(1)).alias("_nb")), cell)
    # Crowded cells are at most a few for each SLICE rows.
    crowded = F.broadcast(sizes.where((F.col("_na") > SLICE) | (F.col("_nb") > SLICE)).select(*cell, F.ceil(F.col("_na") / SLICE).alias("_ta"), F.ceil(F.col("_nb") / SLICE).alias("_tb")))
    dealt = lambda df, n: F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(n)), F.lit(0)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)).cast("int") - 1))
    a = a.join(crowded, cell, "left").withColumn("_sa", dealt(left, "_ta")).withColumn("_sb", every("_tb")).drop("_ta", "_tb")
    b = b.join(crowded, cell, "left").withColumn("_sb", dealt(right.select("sx", "sy"), "_tb")).withColumn("_sa", every("_ta")).drop("_ta", "_tb")
    keys = [*cell, "_sa", "_sb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in columns]


def _fine(x: np.ndarray, y: np.ndarray, rows: float) -> float:
    """Width of cells that would hold so many of these rows if they were even."""
    wide, high = np.ptp(x), np.ptp(y)
    return float(np.sqrt(wide * high * rows / len(x)) or max(wide, high) * rows / len(x))


def _slack(*arrays: np.ndarray) -> float:
    """More than what rounding can move a coordinate over the border of its fine cell."""
    return 16 * np.finfo(float).eps * max(float(np.abs(a).max()) for a in arrays)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to below its high."""
    low, n = low[high > low], (high - low)[high > low]
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def nearest_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int, radius: float, on: Sequence[str] = (), apart: tuple[str, str] | None = None) -> DataFrame:
    """(keys, on, distance, other columns of both sides): for each key the ``most`` nearest rows of ``right`` (sx, sy) to ``left``
    (x, y) within ``radius``, ties by sx, sy and the other columns of ``right``; of ``apart`` columns, the values must differ."""
    left, right = left.withColumns({c: F.col(c).cast("double") for c in ("x", "y")}), right.withColumns({c: F.col(c).cast("double") for c in ("sx", "sy")})
    if apart:
        left, right = left.where(F.col(apart[0]).isNotNull()), right.where(F.col(apart[1]).isNotNull())
    taken = [c for c in right.columns if c not in ("sx", "sy", *on)]
    carried = [c for c in left.columns if c not in ("x", "y", *keys, *on)]
    near = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("sx", T.DoubleType()), T.StructField("sy", T.DoubleType()), *[T.StructField(c, right.schema[c].dataType) for c in taken], *[T.StructField(c, left.schema[c].dataType) for c in carried]])
    schema = T.StructType([*[T.StructField(c, left.schema[c].dataType) for c in (*keys, *on)], T.StructField("near", T.ArrayType(near))])
    # Of equal places no more than ``most`` can be among the nearest; they are told by their order.
    place = ["sx", "sy", *on, *([apart[1]] if apart else [])]
    right = right.withColumn("_o", F.row_number().over(Window.partitionBy(*place).orderBy(*(taken or place)))).where(F.col("_o") <= most)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _nearest(*_numbers(a, "x", "y"), *_numbers(b, "sx", "sy", "_o"), *(_numbers(a, apart[0]) + _numbers(b, apart[1]) if apart else (None, None)), most, radius) if len(a) and len(b) else None
        who, site, gap = found or (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        new = np.flatnonzero(np.diff(who, prepend=-1))
        one = lambda t, c, at: t[c].combine_chunks().take(pa.array(at))
        fields = [pa.array(gap, pa.float64()), *[one(b, c, site) for c in ("sx", "sy", *taken)], *[one(a, c, who) for c in carried]]
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)), pa.int32()), pa.StructArray.from_arrays(fields, names=near.names))
        return pa.Table.from_arrays([*[one(a, c, who[new]) for c in (*keys, *on)], lists], names=schema.names)

    lists = _meet(left, right, radius, on, run, schema).groupBy(*keys, *on).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near"))
    return lists.select(*keys, *on, F.inline("near"))


def _nearest(tx, ty, sx, sy, order, fold, other, most: int, radius: float):
    """(row, site, distance), by row: rings of fine cells around each cell of rows, until the last of the nearest lies within them."""
    by = np.lexsort((*([other] if other is not None else []), order, sy, sx))
    sx, sy, other = sx[by], sy[by], None if other is None else other[by]
    f, slack = min(max(_fine(sx, sy, max(2.0, most / 2)), radius / 256), radius * 1.001), _slack(tx, ty, sx, sy)
    x0, y0 = min(tx.min(), sx.min()), min(ty.min(), sy.min())
    column = lambda v: ((v - y0) // f).astype(np.int64)
    columns = int(max(column(ty).max(), column(sy).max())) + 1
    code = lambda x, y: ((x - x0) // f).astype(np.int64) * columns + column(y)
    cs, ct = code(sx, sy), code(tx, ty)
    sites = np.argsort(cs, kind="stable")
    cs, rows = cs[sites], np.argsort(ct, kind="stable")
    cells, start = np.unique(ct[rows], return_index=True)
    out = []
    for c, todo in zip(cells, np.split(rows, start[1:])):
        (i, j), ring = divmod(int(c), columns), 1
        while len(todo):
            at = np.arange(max(i - ring, 0), i + ring + 1) * columns
            met = np.sort(sites[_ranges(np.searchsorted(cs, at + max(j - ring, 0)), np.searchsorted(cs, at + min(j + ring, columns - 1), "right"))])
            sure = ring * f - slack
            whole, left = sure >= radius, []
            if whole or len(met) >= most:
                m = min(most, len(met))
                for part in np.array_split(todo, max(1, -(-len(todo) * len(met) // BLOCK))):
                    dx, dy = tx[part, None] - sx[met], ty[part, None] - sy[met]
                    d = np.sqrt(dx * dx + dy * dy)
                    d[d > radius] = np.inf
                    if other is not None:
                        d[fold[part, None] == other[met]] = np.inf
                    best = np.argsort(d, axis=1, kind="stable")[:, :m]
                    d = np.take_along_axis(d, best, axis=1)
                    final = np.full(len(part), True) if whole else d[:, -1] <= sure
                    hit = np.isfinite(d) & final[:, None]
                    out.append((np.repeat(part, hit.sum(axis=1)), met[best[hit]], d[hit]))
                    left.append(part[~final])
                todo = np.concatenate(left)
            ring *= 2
    who, site, gap = (np.concatenate(x) for x in zip(*out))
    o = np.argsort(who, kind="stable")
    return who[o], by[site[o]], gap[o]


def sums_within(places: DataFrame, radius: float) -> DataFrame:
    """(x, y, n, s): for each distinct place (x, y, c, s) the sums of ``c`` and ``s`` over all others at most ``radius`` away; places without any may lack."""
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _numbers(a, "x", "y")
        n, s = _sums(x, y, *_numbers(b, "sx", "sy", "c", "s"), radius) if len(a) and len(b) else (np.zeros(len(a)), np.zeros(len(a)))
        return pa.table({"x": x, "y": y, "n": n, "s": s}, schema=pa.schema([(c, pa.float64()) for c in schema.names]))

    met = _meet(places.select("x", "y"), places.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "c", "s"), radius, (), run, schema)
    return met.groupBy("x", "y").agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"))


def _sums(tx, ty, sx, sy, count, value, radius: float):
    """Fine cells that lie wholly within the radius of all of a cell count as one; rows of those that its border may cross are compared."""
    m = int(min(max(radius / (_fine(sx, sy, ROWS) or radius), 1), FINE))
    f, slack, q = radius / m, _slack(tx, ty, sx, sy), m + 2
    x0, y0 = min(tx.min(), sx.min()), min(ty.min(), sy.min())
    column = lambda v: ((v - y0) // f).astype(np.int64) + q
    columns = int(max(column(ty).max(), column(sy).max())) + q + 1
    code = lambda x, y: ((x - x0) // f).astype(np.int64) * columns + column(y)
    cs = code(sx, sy)
    o = np.argsort(cs, kind="stable")
    cs, sx, sy, weigh = cs[o], sx[o], sy[o], np.column_stack([count[o], value[o]]).astype(float)
    full, begin = np.unique(cs, return_index=True)
    total = np.add.reduceat(weigh, begin, axis=0)
    ct = code(tx, ty)
    rows = np.argsort(ct, kind="stable")
    cells, start = np.unique(ct[rows], return_index=True)
    di, dj = (d.ravel() for d in np.meshgrid(np.arange(-q, q + 1), np.arange(-q, q + 1), indexing="ij"))
    far, near = f * np.hypot(abs(di) + 1, abs(dj) + 1) + slack, f * np.hypot(np.maximum(abs(di) - 1, 0), np.maximum(abs(dj) - 1, 0)) - slack
    inside = (far <= radius * (1 - 1e-9)) & ((di != 0) | (dj != 0))
    edge = (near <= radius * (1 + 1e-9)) & ~inside
    sure = np.zeros((len(cells), 2))
    for offset in (di * columns + dj)[inside]:
        at = np.minimum(np.searchsorted(full, cells + offset), len(full) - 1)
        sure += np.where((full[at] == cells + offset)[:, None], total[at], 0.0)
    offset = (di * columns + dj)[edge]
    first = np.flatnonzero(np.diff(offset, prepend=offset[0] - 2) != 1)
    runs = np.column_stack([offset[first], offset[np.append(first[1:], len(offset)) - 1]])
    out = np.zeros((len(tx), 2))
    for c, known, some in zip(cells, sure, np.split(rows, start[1:])):
        met = _ranges(np.searchsorted(cs, c + runs[:, 0]), np.searchsorted(cs, c + runs[:, 1], "right"))
        for part in np.array_split(some, max(1, -(-len(some) * len(met) // BLOCK))):
            dx, dy = tx[part, None] - sx[met], ty[part, None] - sy[met]
            d = np.sqrt(dx * dx + dy * dy)
            hit = d <= radius
            zero = np.nonzero(d == 0)
            hit[zero] = (dx[zero] != 0) | (dy[zero] != 0)
            out[part] = known + hit.astype(float) @ weigh[met]
    return out[:, 0], out[:, 1]
