"""Shared helpers: materialised intermediates, token hashing and guards."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of (at most) two numbers that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Largest number of bytes of text that is broadcast.
BROADCAST_BYTES = 32 << 20

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cohorta-"))
    return base.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/cohorta-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cohorta_path = path
    return out


def materialize_buckets(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """As :func:`materialize`, in ``buckets`` by ``key``: a later grouping by ``key`` reads the table where it lies, without a shuffle."""
    spark = df.sparkSession
    path, name = work_path(spark, tag), f"cohorta_{tag}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._cohorta_path, out._cohorta_table = path, name
    return out


def drop(df: DataFrame) -> None:
    """Delete what :func:`materialize` or :func:`materialize_buckets` wrote, when no later plan reads it."""
    path, name = getattr(df, "_cohorta_path", None), getattr(df, "_cohorta_table", None)
    spark = df.sparkSession
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side of known, bounded size; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_columns_of(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns of ``df`` named in ``wanted`` with those types; any that lack are null. Extra columns are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) from a keyed md5 of the columns (52 bits); the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k consecutive word hashes."""
    n = len(h) - k + 1
    acc = np.full(n, (0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return acc


def shingle_set(words: list[bytes], k: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence as one where there are fewer words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    s = np.sort(fold(h, min(k, len(words))))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
