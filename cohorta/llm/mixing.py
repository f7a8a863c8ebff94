"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output divided by the rows it has, so that the expected
output is ``total`` rows in the target proportions. Each document's repeat count is the quantile of a
Poisson distribution with that mean at a keyed hash of the document, so every run and every executor
gives the same counts. Each document is exploded by its count and the copies are shuffled globally:
dealt out by, and sorted on, a keyed hash of document and copy.

Only DataFrame functions are used. Source counts are pre-aggregated before the shuffle, and the table
of rates is joined back by source; where there are more sources than may be broadcast, that join shuffles.

Edge cases: a null source is a source of its own; sources without a weight share what the named ones
leave, in proportion to their rows; weights of sources that are absent are left out and the others
scaled up; where the named weights come to 1 or more, sources without one get no copies; rows that agree in
id and source get the same count, null ids one count for all of a source; a rate of 0 gives no copies; an
empty table stays empty; input columns named like the three that are added are replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, unit_hash, unused

SEED = 20240607


def poisson_quantile(rate: Column, u: Column) -> Column:
    """Smallest k whose cumulative Poisson probability reaches u. Beyond a rate of 700, where exp(-rate) comes near its
    underflow, the sum starts 12 standard deviations below the mean, with that term from Stirling's series; what lies
    before it is less than 1e-30."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("long")
    large = rate > 700
    low = F.when(large, F.floor(rate - 12 * F.sqrt(rate) - 20)).otherwise(0).cast("long")
    x = F.when(large, low.cast("double")).otherwise(1.0)
    log_first = x * F.log(rate / x) + x - rate - F.log(2 * math.pi * x) / 2 - 1 / (12 * x) + 1 / (360 * x * x * x)
    first = F.when(large, F.exp(log_first)).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("cdf"), F.when(first >= u, low).otherwise(low + 1).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        cdf = s["cdf"] + p
        return F.struct(p.alias("p"), cdf.alias("cdf"), F.when(cdf >= u, s["k"]).otherwise(s["k"] + 1).alias("k"))

    return F.aggregate(F.sequence(low + 1, most), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", total: int | None = None) -> tuple[DataFrame, int]:
    """(source, n, weight, rate) for each source of ``docs``, and the number of sources."""
    named = F.lit(None).cast("double")
    for name, w in weights.items():
        named = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(named)
    n = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")).withColumn("named", named)
    k, rows, rest, given = n.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.when(F.col("named").isNull(), F.col("n"))), F.sum("named")).first()
    left = max(0.0, 1.0 - sum(weights.values())) if rest else 0.0
    weight = F.coalesce("named", F.lit(left) * F.col("n") / F.lit(rest or 1)) / F.lit(((given or 0.0) + left) or 1.0)
    size = total if total is not None else rows or 0
    return n.withColumn("weight", weight).select("source", "n", "weight", (F.col("weight") * F.lit(size) / F.col("n")).alias("rate")), k


def mix(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", total: int | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` and ``mix_repeats``, ``mix_copy`` (from 1) and ``mix_order``, copies in a global random order."""
    table, sources = rates(docs, weights, source_col, total)
    docs = docs.drop("mix_repeats", "mix_copy", "mix_order")
    source, rate = unused(docs, "mix_source"), unused(docs, "mix_rate")
    table = table.select(F.col("source").alias(source), F.col("rate").alias(rate))
    joined = docs.join(maybe_broadcast(table, sources), F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    counted = joined.withColumn("mix_repeats", poisson_quantile(F.col(rate), unit_hash(F.col(id_col), seed=seed)).cast("int"))
    copies = counted.where("mix_repeats > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_repeats"))))
    ordered = copies.withColumn("mix_order", F.xxhash64(F.lit(seed), F.col(id_col), F.col("mix_copy")))
    return ordered.drop(source, rate).repartition("mix_order").sortWithinPartitions("mix_order", id_col, "mix_copy")
