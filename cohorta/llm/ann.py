"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are lifted to unit norm (one component more, from the largest norm), where the largest inner
product is the smallest Euclidean distance. Each of ``tables`` hash tables keys a vector by ``m`` p-stable
hashes floor((a.x + b) / w) with Gaussian a (Datar et al., 2004). A query visits its own bucket and
perturbed ones in the order of their estimated success, the sum of squared distances to the bucket walls
that are crossed (Lv et al., 2007); all vectors are indexed.

How far a query must look follows from the data. The exact neighbours of ``PILOTS`` queries, from one scan,
tell for each of ``WAYS`` (tables and width) and number of hashes how many probes find the share ``recall``
of them, and a sample of the vectors what those probes would read. The cheapest way is taken: few wide
tables where neighbours lie hardly closer than other vectors, many narrow ones where they lie close. Only
where no way reaches the share are all vectors scanned, block of queries by block of queries. A query that
meets fewer than ``k`` others in its buckets is answered by such a scan as well. A query's ``k + 1``-th best
score in the sample bounds its neighbours' from below, so no way passes on more.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that any list can show of them.
Buckets are met block by block of ``BLOCK`` entries and ``ASKED`` queries, so no task holds more than that
of one bucket; each block gives its best of a query and what ties with the last of them, tables are merged,
and the best are ranked again by exact inner products in double precision.

Edge cases: null vectors, zero ones, and those with null or non-finite components or not of the most
common length take no part, nor do rows with a null id; with fewer than k candidates in the table, all of
them are returned; rows that repeat an id are candidates of their own and one query; an empty table gives
no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, mix64

K = 20
BLOCK, ASKED = 4096, 2048
#: (tables, width) that are tried.
WAYS = ((1, 3.0), (1, 2.0), (2, 2.0), (2, 1.0), (4, 1.0), (4, 0.5))
#: Entries that a bucket holds at least, on average; it limits the hashes that are tried.
BUCKET = 64
#: Share of the neighbours that the pilot queries must find, above the 0.9 that is asked for as it is an estimate.
RECALL, PILOTS = 0.95, 200
#: Bytes of the vectors that bound the scores and stand for all in estimates (and their share of all, at most), of the queries of one scan.
SAMPLE_BYTES, SAMPLE_SHARE, SCAN_BYTES = 8 << 20, 0.125, 16 << 20
#: What a probe costs beside the vectors that it reads, in vectors.
PROBE_COST = 200
#: Scores gathered before they are cut to the best.
HELD = 2_000_000
SEED = 7


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part, as doubles."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (common["d"] if common else 0))


def _projections(dim: int, m: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(tables, dim, m)), rng.uniform(0, width, size=(tables, m))


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))[:, None]])


def _keys(h: np.ndarray) -> np.ndarray:
    """One number for the hashes along the last axis; every hash changes all of its bits."""
    key = np.full(h.shape[:-1], h.shape[-1], dtype=np.uint64)
    for j in range(h.shape[-1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[..., j].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def _combos(m: int) -> np.ndarray:
    """Perturbations of some of m hashes by one step: of up to four of a few hashes, fewer of many."""
    most = 4 if m <= 12 else 3 if m <= 24 else 2
    out = []
    for k in range(min(m, most) + 1):
        for places in itertools.combinations(range(m), k):
            for signs in itertools.product((-1, 1), repeat=k):
                c = np.zeros(m, dtype=np.int8)
                c[list(places)] = signs
                out.append(c)
    return np.array(out)


def _index(dim: int, m: int, tables: int, width: float, largest: float):
    a, b = _projections(dim + 1, m, tables, width)

    def run(frames):
        for f in frames:
            x = _lift(np.array(f["v"].tolist(), dtype=float).reshape(-1, dim), largest)
            for t in range(tables):
                yield pd.DataFrame({"t": t, "key": _keys(np.floor((x @ a[t] + b[t]) / width)), "id": f["id"], "v": f["v"]})

    return run


def _ordered(p: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Places of ``combos`` in the order of their success for each row of hash values ``p``."""
    down = p - np.floor(p)
    cost = (1 - down) ** 2 @ (combos == 1).T + down**2 @ (combos == -1).T
    return np.argsort(cost, axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])


def _probe(dim: int, m: int, tables: int, width: float, probes: int):
    a, b = _projections(dim + 1, m, tables, width)
    combos = _combos(m)

    def run(frames):
        for f in frames:
            x = _unit(np.array(f["v"].tolist(), dtype=float).reshape(-1, dim))
            for t in range(tables):
                p = (x @ a[t] + b[t]) / width
                key = _keys(np.floor(p)[:, None, :] + combos[_ordered(p, combos)[:, :probes]])
                yield pd.DataFrame({"t": t, "key": key.reshape(-1), "q": np.repeat(f["id"].to_numpy(), key.shape[1])})

    return run


def priced(pilots: np.ndarray, near: np.ndarray, of: np.ndarray, sample: np.ndarray, n: int, largest: float, m: int, tables: int, width: float, recall: float, probe_cost: float) -> tuple[float, int] | None:
    """Cost of a query with ``m`` hashes, and the probes that find ``recall`` of ``near``, the neighbours of ``pilots[of]``; None where none do."""
    dim = pilots.shape[1]
    x, y, z = _unit(pilots), _lift(near, largest), _lift(sample, largest)
    a, b = _projections(dim + 1, m, tables, width)
    combos = _combos(m)
    codes = _keys(combos)
    sort = np.argsort(codes)
    needed = np.full(len(near), len(combos))
    asked, orders = [], []
    for t in range(tables):
        p = (x @ a[t] + b[t]) / width
        order = _ordered(p, combos)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(combos))[None, :], 1)
        step = (np.floor((y @ a[t] + b[t]) / width) - np.floor(p)[of]).astype(np.int64)
        code = _keys(step)
        spot = sort[np.minimum(np.searchsorted(codes, code, sorter=sort), len(combos) - 1)]
        needed = np.minimum(needed, np.where(codes[spot] == code, place[of, spot], len(combos)))
        asked.append(np.floor(p))
        orders.append(order)
    probes = int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1
    if probes > len(combos):
        return None
    read = 0
    for t in range(tables):
        held, sizes = np.unique(_keys(np.floor((z @ a[t] + b[t]) / width)), return_counts=True)
        keys = _keys(asked[t][:, None, :] + combos[orders[t][:, :probes]]).reshape(-1)
        spots = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        read += sizes[spots][held[spots] == keys].sum()
    return read / len(x) * n / len(z) + probe_cost * probes * tables, probes


def plan(pilots: np.ndarray, near: np.ndarray, of: np.ndarray, sample: np.ndarray, n: int, largest: float, recall: float, probe_cost: float, ways=WAYS, bucket: int = BUCKET) -> tuple[int, int, int, float] | None:
    """(hashes, probes, tables, width) of the cheapest way that finds ``recall`` of ``near``; None where no way does."""
    best = None
    for tables, width in ways:
        # a hash of a unit vector's projection cuts space to about 4.13 / width cells
        for m in range(1, 2 + int(np.log(max(n / bucket, 1)) / np.log(max(4.13 / width, 1.2)))):
            got = priced(pilots, near, of, sample, n, largest, m, tables, width, recall, probe_cost)
            if got and (best is None or got[0] < best[0]):
                best = (got[0], m, got[1], tables, width)
            elif got and got[0] > 4 * best[0]:
                break
    return best[1:] if best else None


class _Held:
    """The k best scores of each query and what ties with the last of them, of what is added; ``bound`` rises with them."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k, self.bound, self.parts, self.size = k, bound.copy(), [], 0

    def add(self, qs: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(qs), 512):
            s = qs[at : at + 512] @ x.T
            q, i = np.nonzero(s >= self.bound[at : at + 512, None])
            self.parts.append((q + at, ids[i], s[q, i]))
            self.size += len(q)
            if self.size > HELD:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, i, s = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        places = np.arange(len(q))
        first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]][: len(q)], places, 0))
        last = places - first == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], _below(s[last]))
        keep = s >= self.bound[q]
        keep |= places - first < self.k
        self.parts, self.size = [(q[keep], i[keep], s[keep])], int(keep.sum())
        return self.parts[0]


def _below(s: np.ndarray) -> np.ndarray:
    """A little less, as sums in another order differ in their last digits."""
    return s - 1e-9 * np.maximum(1.0, np.abs(s))


def _best(k: int):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        held = _Held(k, asked["bound"].to_numpy(dtype=float))
        held.add(np.array(asked["qv"].tolist(), dtype=float), index["id"].to_numpy(), np.array(index["v"].tolist(), dtype=float))
        q, i, s = held.cut()
        return pd.DataFrame({"q": asked["q"].to_numpy()[q], "id": i, "score": s})

    return run


def _bounds(sample, k: int):
    def run(frames):
        ids = np.arange(len(sample.value))
        for f in frames:
            x, bound = np.array(f["v"].tolist(), dtype=float), np.full(len(f), -np.inf)
            if len(f) and len(ids) >= k:
                for at in range(0, len(x), 512):
                    s = x[at : at + 512] @ sample.value.T
                    bound[at : at + 512] = _below(-np.partition(-s, k - 1, axis=1)[:, k - 1])
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "bound": bound})

    return run


def _scan(asked, k: int):
    def run(frames):
        q, qv, bound = asked.value
        held = _Held(k, bound)
        for f in frames:
            if len(f):
                held.add(qv, f["id"].to_numpy(), np.array(f["v"].tolist(), dtype=float))
        at, i, s = held.cut()
        yield pd.DataFrame({"q": q[at], "id": i, "score": s})

    return run


def _scanned(classes: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    """(q, id, score): the k best of each row of ``asked`` (id, v, bound), of each task's vectors."""
    sent = classes.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), np.array(asked["v"].tolist(), dtype=float), asked["bound"].to_numpy(dtype=float)))
    return classes.mapInPandas(_scan(sent, k), "q long, id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, ways=WAYS, bucket: int = BUCKET, block: int = BLOCK, asked_block: int = ASKED, probe_cost: float = PROBE_COST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id fulfils ``is_query`` (a Column of ``id``)."""
    rows = materialize(clean(vectors, id_col, vec_col), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    # ids of equal vectors: the k + 1 smallest stand for all
    firsts = materialize(rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    n, largest = firsts.agg(F.count(F.lit(1)), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))).first()
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    dim = len(firsts.first()["v"])
    classes = firsts.select(F.col("rep").alias("id"), "v")
    asking = rows.where(is_query(F.col("id"))).distinct().join(firsts.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep")
    asking = materialize(asking, "asking")
    points = lambda f: np.array(f["v"].tolist(), dtype=float).reshape(-1, dim)
    sample = points(classes.orderBy(F.xxhash64("id"), "id").limit(max(k + 1, min(SAMPLE_BYTES // (8 * dim), int(n * SAMPLE_SHARE)))).select("v").toPandas())
    sent = spark.sparkContext.broadcast(sample)
    asked = classes.join(asking.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInPandas(_bounds(sent, k + 1), "id long, v array<double>, bound double")
    asked = materialize(asked, "asked")
    if asked.isEmpty():
        return empty

    def cut(met: DataFrame) -> DataFrame:
        """(q, id) of the k + 1 best scores of each query, and of those that may tie with the last."""
        best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        once = met.repartition("q").groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best))
        last = F.max(F.when(F.col("r") == k + 1, F.col("score"))).over(Window.partitionBy("q"))
        return once.withColumn("last", last).where((F.col("r") <= k + 1) | (F.col("score") >= F.col("last") - 1e-9 * F.greatest(F.lit(1.0), F.abs("last")))).select("q", "id")

    def scanned(some: DataFrame) -> DataFrame:
        """(q, id) of the best of all vectors for the rows of ``some``, so many at a time."""
        parts = -(-some.count() * 8 * dim // SCAN_BYTES)
        spread = materialize(classes.repartition(max(spark.sparkContext.defaultParallelism, -(-n * 8 * dim // SCAN_BYTES)), "id"), "spread")
        turn = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(parts))
        out = [materialize(cut(_scanned(spread, some.where(turn == i).toPandas(), k + 1)), "scanned") for i in range(parts)]
        drop(spread)
        return reduce(DataFrame.union, out)

    pilots = asked.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(PILOTS).toPandas().sort_values("id")
    near = cut(_scanned(classes, pilots, k + 1)).where("q != id").join(classes, "id").select("q", "v").toPandas()
    of = np.searchsorted(pilots["id"].to_numpy(), near["q"].to_numpy())
    way = plan(points(pilots), points(near), of, sample, n, largest, recall, probe_cost, ways, bucket) if len(near) else None
    if way:
        m, probes, tables, width = way
        index = materialize(classes.mapInPandas(_index(dim, m, tables, width, largest), "t int, key long, id long, v array<double>"), "index")
        probing = materialize(asked.select("id", "v", "bound").mapInPandas(_probe(dim, m, tables, width, probes), "t int, key long, q long"), "probing")
        blocks = lambda df, most, name: df.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
        sizes = materialize(blocks(index, block, "ni").join(blocks(probing, asked_block, "nq"), ["t", "key"]), "sizes")
        split = lambda df, own, other, by, to: df.join(sizes, ["t", "key"]).withColumns({own: F.pmod(F.xxhash64(by), F.col(f"n{own}")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))}).select("t", "key", "i", "q_", *to)
        sizes = sizes.withColumnRenamed("nq", "nq_")
        queries = asked.select(F.col("id").alias("q"), F.col("v").alias("qv"), "bound")
        left = split(index, "i", "q_", "id", ["id", "v"])
        right = split(probing, "q_", "i", "q", ["q"]).join(queries, "q")
        by = ["t", "key", "i", "q_"]
        found = materialize(cut(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_best(k + 1), "q long, id long, score double")), "found")
        drop(index), drop(probing)
        # a class of equal vectors lists as many of its ids, the query's own included
        listed = found.join(firsts.select(F.col("rep").alias("id"), F.size("ids").alias("c")), "id").groupBy(F.col("q").alias("id")).agg(F.sum("c").alias("c")).where(F.col("c") > k)
        few = materialize(asked.join(listed, "id", "left_anti"), "few")
        if not few.isEmpty():
            found = found.join(few.select(F.col("id").alias("q")), "q", "left_anti").union(scanned(few))
    else:
        found = scanned(asked)
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = found.join(classes.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q").join(classes, "id").select(F.col("q").alias("rep"), "id", dot.alias("score"))
    listed = exact.join(firsts.select(F.col("rep").alias("id"), "ids"), "id").select("rep", "score", F.explode("ids").alias("vec_id"))
    best = listed.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return asking.join(best.drop("r"), "rep").where("vec_id != query_id").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
