"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters as they are (NUL counts as a space), the model is of order ``ORDER``, and no
table is bounded by an alphabet: the n-grams of all trusted documents are counted, and the tables of
every order stay in the cluster, sharded by n-gram. Documents are cut into blocks of about
``BLOCK_CHARS`` characters (a longer document is one block); a block holds its texts, packed, and its
distinct n-grams with their counts in trusted text. N-grams of all blocks are summed by n-gram, each
gets its probability from joins with the counts and contexts of every order, and the probabilities
go back to the blocks that hold the n-gram, where each document's perplexity is taken. What moves is
the distinct n-grams of each block, which grow with the text; the packed text is written once, in
buckets by block, and scored where it lies.

Perplexity is smoothed for short documents: each counts as if it had ``PRIOR`` more symbols of the
trusted text's own mean. Scores of text that the model was trained on are too good to set limits for
other text, so one in ``HOLD`` trusted documents (by a hash of the id) is left out of the counts and
sets the thresholds: a document is rejected where its perplexity exceeds ``margin`` times the quantile
of those of its language. Languages without any take the quantile over all of them, and where no
trusted document was left out, all trusted documents serve.

Characters do not tell a run of one good word from text, so words have a score of their own: the largest
share of words that equal the word one, two or three places before, smoothed by ``PRIOR_WORDS`` words of
the trusted mean. It has a threshold of the same kind, of ``LEAST_REPEATS`` or more.

Edge cases: null and empty texts have no perplexity (null) and are kept, as nothing speaks against
them; a null language is a language of its own; without any trusted text no document is rejected;
repeated ids are scored row by row.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fold, materialize, materialize_buckets, maybe_broadcast

ORDER = 4
#: Symbols of the trusted mean that each document's score is smoothed with.
PRIOR = 60
QUANTILE, MARGIN = 0.995, 1.1
#: Words of the trusted mean that the share of repeated words is smoothed with, and a share that is never too much.
PRIOR_WORDS, LEAST_REPEATS = 12, 0.1
#: Distances at which words are compared.
LAGS = (1, 2, 3)
#: One in so many trusted documents sets the thresholds; the others train the model.
HOLD = 4
#: Characters of a block, and of the texts that are looked up together.
BLOCK_CHARS, PART_CHARS = 8_000_000, 1_000_000
#: Buckets that the blocks are written in: one for each block's worth of text, to Spark's own bound.
MAX_BUCKETS = 100_000
START = 2
_BLOCK = "block string, docs binary, ids array<long>, langs array<string>, sizes array<long>, grams array<string>, counts array<long>"


def symbols(text: str, order: int) -> np.ndarray:
    """Code points after ``order - 1`` start symbols."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.full(len(code) + order - 1, START, dtype=np.uint32)
    out[order - 1 :] = np.where(code == 0, np.uint32(32), code)
    return out


def hashes(code: np.ndarray, order: int) -> np.ndarray:
    return fold(code.astype(np.uint64), order)


class _Grams:
    """Distinct n-grams of one block with their counts in trusted text."""

    def __init__(self, order: int):
        self.order, self.parts, self.held, self.waiting = order, [], [], 0

    def add(self, text: str, known: bool) -> None:
        code = symbols(text, self.order)
        self.held.append((code, known))
        self.waiting += len(code)
        if self.waiting >= PART_CHARS:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        code = np.concatenate([c for c, _ in self.held])
        keys = np.concatenate([hashes(c, self.order) for c, _ in self.held])
        sizes = [len(c) - self.order + 1 for c, _ in self.held]
        weight = np.repeat(np.array([k for _, k in self.held], dtype=np.int64), sizes)
        first = np.repeat(np.arange(len(sizes)) * (self.order - 1), sizes) + np.arange(len(keys))
        h, at, inv = np.unique(keys, return_index=True, return_inverse=True)
        windows = np.lib.stride_tricks.sliding_window_view(code, self.order)[first[at]]
        self.parts.append((h, np.ascontiguousarray(windows), np.bincount(inv, weights=weight, minlength=len(h)).astype(np.int64)))
        self.held, self.waiting = [], 0

    def result(self) -> tuple[list[str], np.ndarray]:
        self.merge()
        if not self.parts:
            return [], np.empty(0, dtype=np.int64)
        h, at, inv = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        windows = np.concatenate([p[1] for p in self.parts])[at]
        counts = np.bincount(inv, weights=np.concatenate([p[2] for p in self.parts]), minlength=len(h)).astype(np.int64)
        return windows.view(f"<U{self.order}").reshape(-1).tolist(), counts


def _blocks(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            data = [t.encode("utf-8", "replace") for t in texts]
            grams, counts = found.result()
            packed = zlib.compress(b"".join(data), 6)
            cells = [f"{task}-{made}", packed, ids, langs, [len(x) for x in data], grams, counts.tolist()]
            types = [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=["block", "docs", "ids", "langs", "sizes", "grams", "counts"])

        ids, langs, texts, found, chars = [], [], [], _Grams(order), 0
        for batch in batches:
            for i, lang, known, text in zip(*(batch.column(k) for k in range(4))):
                t = text.as_py() or ""
                ids.append(i.as_py())
                langs.append(lang.as_py())
                texts.append(t)
                chars += len(t)
                if t:
                    found.add(t, bool(known.as_py()))
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_CHARS // 64:
                    yield close()
                    ids, langs, texts, found, chars, made = [], [], [], _Grams(order), 0, made + 1
        if ids:
            yield close()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more (Chen and Goodman, 1999), held inside (0, count)."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1)]


def probabilities(counted: DataFrame, order: int) -> DataFrame:
    """(gram, n, p) for every row of ``counted`` (gram, n in trusted text): its last symbol's probability after the others."""
    counts = {order: counted.where("n > 0")}
    for k in range(order - 1, 0, -1):
        counts[k] = materialize(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"counts{k}")
    p = None
    for k in range(1, order + 1):
        have = counts[k].agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)], F.count(F.lit(1)), F.sum("n")).first()
        d = discounts(*have[:4])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        wanted = counted.select(F.substring("gram", order - k + 1, k).alias("gram")).distinct() if k < order else counted.select("gram")
        seen = counts[k].select("gram", (F.col("n") - cut).alias("own"))
        if k == 1:
            held = counts[1].agg(F.sum(cut)).first()[0]
            p = wanted.join(seen, "gram", "left").select("gram", ((F.coalesce("own", F.lit(0.0)) + F.lit(held / (have[4] + 1))) / F.lit(float(have[5]))).alias("p"))
        else:
            ctx = counts[k].groupBy(F.substring("gram", 1, k - 1).alias("ctx")).agg(F.sum("n").alias("total"), F.sum(cut).alias("held"))
            lower = p.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            parts = wanted.select("gram", F.substring("gram", 1, k - 1).alias("ctx"), F.substring("gram", 2, k - 1).alias("tail")).join(lower, "tail").join(ctx, "ctx", "left").join(seen, "gram", "left")
            p = parts.select("gram", F.when(F.col("total") > 0, (F.coalesce("own", F.lit(0.0)) + F.col("held") * F.col("low")) / F.col("total")).otherwise(F.col("low")).alias("p"))
        p = materialize(p, f"p{k}")
    return p.join(counted, "gram").select("gram", "n", "p")


def repeats(words: list[str]) -> int:
    """The most words that equal the one at any of ``LAGS`` before."""
    return max(sum(map(operator.eq, words, words[k:])) for k in LAGS)


def _score(order: int, mean: float):
    def run(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "lang": [], "perplexity": [], "words": [], "repeated": []}
        if len(known):
            code = np.frombuffer("".join(known["gram"]).encode("utf-32-le"), dtype=np.uint32).reshape(-1, order)
            keys = np.array(np.concatenate([hashes(code[at : at + PART_CHARS].reshape(-1), order)[::order] for at in range(0, len(code), PART_CHARS)]))
            sort = np.argsort(keys)
            keys, logs = keys[sort], known["logp"].to_numpy(dtype=np.float64)[sort]
        for row in block.itertuples(index=False):
            data, at = zlib.decompress(row.docs), 0
            for i, lang, size in zip(row.ids, row.langs, row.sizes):
                text, at = data[at : at + size].decode("utf-8"), at + size
                out["id"].append(i)
                out["lang"].append(lang)
                words = text.split()
                out["words"].append(len(words))
                out["repeated"].append(repeats(words))
                if not text:
                    out["perplexity"].append(None)
                    continue
                got, n = 0.0, len(text)
                h = hashes(symbols(text, order), order)
                for b in range(0, n, PART_CHARS):
                    got += logs[np.searchsorted(keys, h[b : b + PART_CHARS])].sum()
                out["perplexity"].append(float(np.exp(-(got + PRIOR * mean) / (n + PRIOR))))
        return pd.DataFrame({"id": pd.array(out["id"], dtype="Int64"), "lang": pd.Series(out["lang"], dtype=object), "perplexity": pd.Series(out["perplexity"], dtype="float64").astype(object).where(lambda s: s.notna(), None), "words": out["words"], "repeated": out["repeated"]})

    return run


def perplexities(src: DataFrame, order: int = ORDER) -> DataFrame | None:
    """(id, lang, perplexity, words, repeated) of rows (id, lang, known, text) under the model of the known rows; None where those have no text."""
    chars = src.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = min(1 + chars // BLOCK_CHARS, MAX_BUCKETS)
    blocks = materialize_buckets(src.select("id", "lang", "known", "text").mapInArrow(_blocks(order), _BLOCK), "blocks", "block", buckets)
    grams = blocks.select("block", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("block", F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))
    counted = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "counted")
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        drop(blocks)
        return None
    model = materialize(probabilities(counted, order).select("gram", "n", F.log("p").cast("float").alias("logp")), "model")
    mean = model.agg(F.sum(F.col("n") * F.col("logp"))).first()[0] / total
    told = grams.select(F.col("block").alias("place"), "gram").join(model.select("gram", "logp"), "gram")
    out = blocks.select("block", "docs", "ids", "langs", "sizes").groupBy("block").cogroup(told.groupBy("place")).applyInPandas(_score(order, mean), "id long, lang string, perplexity double, words long, repeated long")
    out = materialize(out, "perplexity")
    drop(blocks)
    return out


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, order: int = ORDER) -> DataFrame:
    """A row for each row of ``docs``: id, lang, perplexity, threshold, repeats, repeats_threshold and kept; ``trusted`` holds the ids of trusted text."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    ids = ids.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(HOLD)) == 0)
    trains = maybe_broadcast(ids.where("not held").select("id", F.lit(True).alias("known")), n := ids.count())
    scored = perplexities(src.join(trains, "id", "left"), order)
    if scored is None:
        return src.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("repeats"), F.lit(None).cast("double").alias("repeats_threshold"), F.lit(True).alias("kept"))
    said = scored.join(maybe_broadcast(ids, n), "id").agg(F.sum("repeated") / F.sum("words")).first()[0] or 0.0
    scored = scored.withColumn("repeats", (F.col("repeated") + F.lit(PRIOR_WORDS * said)) / (F.col("words") + F.lit(PRIOR_WORDS)))
    cut = F.percentile_approx("perplexity", quantile, 10000) * F.lit(margin)
    cut_repeats = F.greatest(F.percentile_approx("repeats", quantile, 10000) * F.lit(margin), F.lit(LEAST_REPEATS))
    fit = scored.join(maybe_broadcast(ids, n), "id").where("perplexity is not null")
    held = fit.where("held")
    every = held.agg(cut.alias("any"), cut_repeats.alias("repeats")).first()
    if every["any"] is None:
        held = fit
        every = fit.agg(cut.alias("any"), cut_repeats.alias("repeats")).first()
    by_lang = held.groupBy("lang").agg(cut.alias("cut"), cut_repeats.alias("cut_repeats")).select(F.col("lang").alias("l"), "cut", "cut_repeats")
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumns({"threshold": F.coalesce("cut", F.lit(every["any"])), "repeats_threshold": F.coalesce("cut_repeats", F.lit(every["repeats"]))})
    kept = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("repeats") <= F.col("repeats_threshold")), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", "threshold", "repeats", "repeats_threshold", kept.alias("kept"))
