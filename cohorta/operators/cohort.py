"""Cohort assembly and grouped description."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.exprs import censored_status


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in the stated order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_status(entities: DataFrame, status: DataFrame, key: str, news: str, flag: str, start: str, end: str) -> DataFrame:
    """Entities joined with their last status: open ends become the study's end, entities lost before its start go, later deaths are censored."""
    last = keep_last(status, [key], [news, flag])
    joined = entities.join(last, key).withColumn(news, F.coalesce(F.col(news), F.lit(end).cast("date")))
    return joined.where(F.col(news) >= F.lit(start).cast("date")).withColumn(f"{flag}_study", censored_status(F.col(flag), F.col(news), end))


def left_chain(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins of the parts, each on its keys. Parts come with one row for each key, but for a first one that fans out on purpose."""
    return reduce(lambda df, part: df.join(part[0], list(part[1]), "left"), parts, base)


def membership_flag(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    return df.join(ids.select(key).distinct().withColumn(out, F.lit(1)), key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def outcome_table(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Size, outcomes, rate in % and share of the cohort in % by group (NULL groups are left out)."""
    by = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(outcome).cast("long")).alias("outcomes"))
    return by.withColumn("rate", F.col("outcomes") * 100.0 / F.col("total")).withColumn("share", F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy(F.lit(1))))


def numeric_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"),
    )


def rate_pivot(df: DataFrame, rows: str, columns: str, levels: Sequence, outcome: str) -> DataFrame:
    """Outcome rate in % by two keys, one column a level, 0 where a cell is empty. Levels are named, so no pass is needed to find them."""
    return df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(columns, list(levels)).agg(F.avg(F.col(outcome).cast("double")) * 100).fillna(0.0)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every cell of two keys in long form with its count, row share in %, and expected count; empty cells count 0."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = n.select(a).distinct().crossJoin(F.broadcast(n.select(b).distinct())).join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    row, col, every = F.sum("n").over(Window.partitionBy(a)), F.sum("n").over(Window.partitionBy(b)), F.sum("n").over(Window.partitionBy(F.lit(1)))
    return cells.select(a, b, "n", (F.col("n") * 100.0 / row).alias("row_pct"), (row.cast("double") * col / every).alias("expected"))


def share_pivot(df: DataFrame, group: str, category: str, levels: Sequence, prefix: str) -> DataFrame:
    """Shares of each category within a group, 0 where it is absent."""
    total = F.count(category)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[(F.count_if(F.col(category) == F.lit(v)) / total).alias(f"{prefix}{v}") for v in levels])


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's r of each pair of columns over the rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def daily_resample(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(value).alias("mean"))


def monthly_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.avg(value).alias("mean"))


def weight_pivot(df: DataFrame, key: str, cluster: str, levels: Sequence) -> DataFrame:
    """How often each entity is in each cluster."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col(cluster) == F.lit(v)).alias(f"cluster_{v}") for v in levels])


def dominant_category(df: DataFrame, key: str, category: str) -> DataFrame:
    """The most frequent category of each entity (smallest of equals), its share in %, the number and list of categories, and their entropy in bits."""
    n = df.where(F.col(key).isNotNull() & F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    p = F.col("n") / F.col("total")
    out = total.groupBy(key).agg(
        F.min(F.struct(-F.col("n"), F.col(category).alias("c"))).alias("best"), F.max("n").alias("freq"), F.first("total").alias("total"), F.count(F.lit(1)).alias("n_distinct"),
        F.sort_array(F.collect_list(category)).alias("visited"), (-F.sum(p * F.log2(p))).alias("entropy"),
    )
    return out.select(key, F.col("best.c").alias("dominant"), "freq", "total", (F.col("freq") * 100.0 / F.col("total")).alias("share"), "n_distinct", "visited", F.abs("entropy").alias("entropy"))


def flag_means(df: DataFrame, keys: Sequence[str], cluster: str, levels: Sequence) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg((F.col(cluster) == F.lit(v)).cast("double")).alias(f"expo_{v}") for v in levels])


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of NULLs of each column, in one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def usable(df: DataFrame, columns: Sequence[str], most: float = 0.3) -> list[str]:
    """The columns with at most that share of NULLs."""
    return [c for c, s in null_shares(df, columns).items() if s <= most]


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def last_values(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The last known value of each column, by ``order``; it is found by an aggregate, so rows are not sorted."""
    return df.groupBy(*keys).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, mean, sd, min, q1, median, q3, max, distinct, nonzero) of numbers, in one pass."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where("v is not null")
    q = lambda p: F.percentile("v", p)
    return x.groupBy("variable").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"),
        F.max("v").alias("max"), F.countDistinct("v").alias("distinct"), F.count_if(F.col("v") != 0).alias("nonzero"),
    )


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, share): rows of each value and their share of the group."""
    n = df.groupBy(*by, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.lit(df.count())
    return n.withColumn("share", F.col("n") / total)


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x_min, y_min, x_max, y_max, points) of coordinates."""
    return df.agg(F.min(x).alias("x_min"), F.min(y).alias("y_min"), F.max(x).alias("x_max"), F.max(y).alias("y_max"), F.countDistinct(x, y).alias("points"))


def hashed_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """The rows of about ``share`` of the ids, by a hash of the id: the same on every run, with all rows of an id."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.where(F.conv(F.substring(text, 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
