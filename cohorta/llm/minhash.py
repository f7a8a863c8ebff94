"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: in round i each element of a document's shingle set is hashed to one of ``t`` bins with a
value that is larger than any of the rounds before; a bin keeps its smallest value. After the round
in which the last bin fills, the sketch is done; rounds t..2t-1 send all elements to bin i-t, so that
every bin fills for any non-empty set. Equal bins of two sketches occur with the sets' Jaccard
similarity, with the concentration of independent minima (Dahlgaard, Knudsen and Thorup, 2017).

``t = bands * rows`` bins are cut into bands. Documents with equal sets form one class; class
representatives that share a band meet in its bucket, and links are confirmed on the full sets.

Buckets never emit all their pairs: each one first compares its members with one leader, and where
members are then still in different components, with another. What is left in different components is
compared on full sets: pair by pair in buckets of up to ``FEW`` members; members of larger buckets are
grouped by the component that most of their bucket is in, and those outside of it are compared with all
of the group whose sizes allow a link. Blocks of ``SIDE`` documents from outside meet blocks of ``SIDE``
of all and give links only, not pairs. So a pair that shares a bucket is compared, or already connected
by confirmed links. What a bucket has in common is summed before it is shuffled and joined back, so a
bucket with most of the documents is split like any skewed join.

Sets are sets of 64-bit hashes of shingles: two shingles count as one with a chance of 2**-64.

Edge cases: null, empty or blank texts have an empty set and are linked with nothing; rows with one
id are one vertex; rows whose id is null are linked with nothing and get a null component; a text
of any length is one set; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, ascii_words, drop, materialize, mix64, shingle_set

BANDS, ROWS = 45, 6
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
#: Documents that are sketched together.
BLOCK = 256
#: Rounds with one leader a bucket, before the pairs that are left.
LEADER_ROUNDS = 1
FEW, SIDE = 12, 4096


def _seeds(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, a row for each set; rows of empty sets stay at the largest value."""
    out = np.full((len(sets), t), _MAX, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    live = np.flatnonzero(sizes)
    if not len(live):
        return out
    values = np.concatenate([sets[i] for i in live])
    owner = np.repeat(np.arange(len(live)), sizes[live])
    part = np.full((len(live), t), _MAX, dtype=np.uint64)
    ids, seeds = live, _seeds(2 * t)
    for i in range(2 * t):
        h = mix64(values ^ seeds[i])
        low = (h & _LOW) | np.uint64(i << 32)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(part.reshape(-1), owner * t + bins, low)
        done = (part != _MAX).all(axis=1)
        if done.any():
            out[ids[done]] = part[done]
            left = ~done
            if not left.any():
                break
            keep = left[owner]
            values, owner = values[keep], (np.cumsum(left) - 1)[owner[keep]]
            part, ids = part[left], ids[left]
    return out


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sk.reshape(len(sk), bands, rows)
    acc = np.broadcast_to(_seeds(bands), (len(sk), bands))
    for j in range(rows):
        acc = mix64(acc ^ cut[:, :, j])
    return acc.view(np.int64)


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), BLOCK):
                sets = [shingle_set(ascii_words(x.as_py()), shingle, cache) for x in texts.slice(at, BLOCK)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                one = np.array([mix64(s).sum() if len(s) else 0 for s in sets], dtype=np.uint64)
                two = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() if len(s) else 0 for s in sets], dtype=np.uint64)
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, BLOCK), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))],
                    names=["id", "n", "h1", "h2", "bands"],
                )

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, known = WordHash(), None, np.empty(0)
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            u, v = a.to_pylist(), b.to_pylist()
            keep = np.zeros(len(u), dtype=bool)
            for i in range(len(u)):
                if v[i] != last or known is None:
                    known, last = shingle_set(ascii_words(tb[i].as_py()), shingle, cache), v[i]
                keep[i] = _similar(shingle_set(ascii_words(ta[i].as_py()), shingle, cache), known, percent)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def _exact(shingle: int, percent: int):
    """Links between different components of one block of documents from outside and one block of all, on full sets."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        cache = WordHash()
        left = block["outside"].to_numpy(dtype=bool)
        node, c = block["node"].to_numpy(), block["c"].to_numpy()
        sets = [shingle_set(ascii_words(t), shingle, cache) for t in block["text"]]
        n = np.array([len(s) for s in sets])
        mine, others = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = [], []
        if len(mine) and len(others):
            starts = np.concatenate(([0], np.cumsum(n[others])[:-1]))
            words, code = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
            mark = np.zeros(len(words), dtype=bool)
            for x in mine:
                mark[:] = False
                at = np.minimum(np.searchsorted(words, sets[x]), len(words) - 1)
                mark[at[words[at] == sets[x]]] = True
                common = np.add.reduceat(mark[code].astype(np.int64), starts)
                ok = (100 * common >= percent * (n[others] + n[x] - common)) & (c[others] != c[x])
                a.append(np.full(int(ok.sum()), node[x]))
                b.append(node[others[ok]])
        return pd.DataFrame({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])})

    return run


def _with(df: DataFrame, by: str, tag: str, where: str, *sums) -> DataFrame:
    """``df`` with what its rows of one ``by`` have in common: summed on each task, written, and joined back, so that a hot key can be split."""
    own = materialize(df.groupBy(by).agg(*sums).where(where), tag)
    out = df.join(own, by)
    out._cohorta_path = own._cohorta_path
    return out


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``edges`` (alternating large and small stars)."""
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new = materialize(small, "stars")
        drop(e)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles, component_id (smallest id reachable over links of ``percent`` or more)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(src.mapInArrow(_signatures(shingle, bands, rows), "id long, n long, h1 long, h2 long, bands array<long>"), "sig")
    linkable = sig.where("n > 0 and id is not null")
    reps = materialize(linkable.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "bands")).alias("m")).select("h1", "h2", F.col("m.id").alias("node"), "n", F.col("m.bands").alias("bands")), "reps")
    met = _with(reps.select("node", "n", F.explode("bands").alias("key")), "key", "leads", "members > 1", F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("members"))
    buckets = materialize(met.select("key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    drop(met)
    texts = materialize(src.join(buckets.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "texts")
    sized = F.expr(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.select("a", "b").distinct()
        met = met.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return materialize(met.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, percent), "a long, b long"), "links")

    links = confirmed(buckets.where(F.col("node") != F.col("lead")).where(sized).select(F.col("node").alias("a"), F.col("lead").alias("b")))
    comp = materialize(connected(links), "components")
    apart, made = buckets.select("key", "node", "n"), [buckets, links]
    for step in range(LEADER_ROUNDS + 1):
        named = materialize(apart.select("key", "node", "n").join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c")), "named")
        met = _with(named, "key", "bounds", "lo != hi", F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64(F.lit(step), "key", "node").alias("r"), "node", "n", "c")).alias("l"))
        apart = materialize(met.select("key", "node", "n", "c", "k", "l"), "apart")
        drop(met), drop(named)
        made.append(apart)
        if apart.isEmpty():
            break
        last = step == LEADER_ROUNDS
        if not last:
            pairs = apart.select("node", "n", "c", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.c").alias("lead_c")).where("c != lead_c").where(sized).select(F.col("node").alias("a"), F.col("lead").alias("b"))
        else:
            few = apart.where(F.col("k") <= FEW)
            other = few.select("key", F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("c").alias("lead_c"))
            pairs = few.join(other, "key").where("node > lead and c != lead_c").where(sized).select(F.col("node").alias("a"), F.col("lead").alias("b"))
            near = _across(apart.where(F.col("k") > FEW).select("key", "node", "n", "c"), texts, shingle, percent)
        more = confirmed(pairs)
        made.append(more)
        more = materialize(more.unionByName(near), "blocklinks") if last else more
        if more.isEmpty():
            continue
        star = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = materialize(connected(star.unionByName(more)), "components")
    classes = materialize(reps.select("h1", "h2", "n", "node").join(comp, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component")), "componentof")
    for x in [*made, texts, reps]:
        drop(x)
    # rows without words or id meet nothing and take no part in the join
    own = sig.select("id", "n", "h1", "h2")
    full = own.where("n > 0 and id is not null").join(classes, ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("component", "id").alias("component_id"))
    rest = own.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _across(many: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between members of large buckets (key, node, n, c) that are in different components.

    Buckets are grouped by the component that most of their members are in; of each pair, one is outside of it.
    Sizes are cut into classes by a factor of 100 / ``percent``, so that links join neighbouring classes at most.
    """
    most = many.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("own"))
    group = many.join(materialize(most, "most"), "key").select("own", "node", "c", "n").distinct().withColumn("size", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    group = materialize(group, "group")
    out = group.where("c != own").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    by = ["own", "size"]
    blocks = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SIDE).alias(name))
    sizes = materialize(blocks(out, "no").join(blocks(group, "na"), by), "blocksizes")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = out.join(sizes, by).select(*by, "node", "c", F.lit(True).alias("outside"), place("no").alias("i"), each("na").alias("j"))
    rest = group.join(sizes, by).select(*by, "node", "c", F.lit(False).alias("outside"), each("no").alias("i"), place("na").alias("j"))
    full = mine.unionByName(rest).join(texts.withColumnRenamed("id", "node"), "node")
    return full.groupBy(*by, "i", "j").applyInPandas(_exact(shingle, percent), "a long, b long")
