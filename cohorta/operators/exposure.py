"""Exposure of entities to daily series: trailing windows, point and month lags, event-relative curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.exprs import STANDARDS, require_columns

LAGS = (0, 1, 2, 3, 7, 15, 31)


def trailing_windows(entities: DataFrame, series: DataFrame, key: str, ref: str, day: str, columns: Sequence[str], lags: Sequence[int] = LAGS, standards: Mapping[str, Mapping[str, float]] = STANDARDS) -> DataFrame:
    """Maxima and exceedances of each column in the last L days up to each entity's reference date.

    One join on the key with one range condition for the longest window; the other windows are
    conditional aggregates of the same rows. L = 0 and L = 1 are both the reference day. Entities
    without rows in the window keep NULL maxima and counts of 0. Limits are exceeded strictly.
    The entities may be large: nothing is broadcast, and the series is cut to the needed columns.
    """
    require_columns(entities, [key, ref])
    require_columns(series, [key, day, *columns])
    longest = max(max(lags), 1)
    e = entities.select(key, F.col(ref).cast("date").alias("date_ref")).distinct()
    s = series.select(F.col(key).alias("_k"), F.col(day).cast("date").alias("_d"), *columns)
    near = e.join(s, (F.col(key) == F.col("_k")) & (F.col("_d") <= F.col("date_ref")) & (F.col("_d") > F.date_sub("date_ref", longest)), "left").withColumn("_back", F.datediff("date_ref", "_d"))
    made = []
    for lag in lags:
        inside = F.col("_back") < max(lag, 1)
        for c in columns:
            made.append(F.max(F.when(inside, F.col(c))).alias(f"max_{c}_J_{lag}"))
            for name, limits in standards.items():
                if c in limits:
                    peaks = F.count_if(inside & (F.col(c) > limits[c]))
                    made += [peaks.alias(f"nb_peaks_{c}_J_{lag}_{name}"), (peaks > 0).cast("int").alias(f"peak_{c}_J_{lag}_{name}")]
    return near.groupBy(key, "date_ref").agg(*made)


def point_lags(entities: DataFrame, series: DataFrame, key: str, ref: str, day: str, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Values at exactly ref - lag days, as columns; one join and a conditional maximum instead of a join per lag. Entities without any row of the series are left out."""
    e = entities.select(key, F.col(ref).cast("date").alias("date_ref")).distinct().join(series.select(key).distinct(), key, "left_semi")
    s = series.select(F.col(key).alias("_k"), F.col(day).cast("date").alias("_d"), *columns)
    back = F.datediff("date_ref", "_d")
    met = e.join(s, (F.col(key) == F.col("_k")) & (F.col("_d") <= F.col("date_ref")) & (F.col("_d") >= F.date_sub("date_ref", max(lags))), "left")
    return met.groupBy(key, "date_ref").agg(*[F.max(F.when(back == lag, F.col(c))).alias(f"{c}_lag_{lag}") for lag in lags for c in columns])


def month_lags(entities: DataFrame, series: DataFrame, key: str, ref: str, day: str, columns: Sequence[str], months: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Values at exactly ref minus k months (clamped at the end of a month)."""
    e = entities.select(key, F.col(ref).cast("date").alias("date_ref")).distinct()
    wanted = e.withColumn("_m", F.explode(F.array(*[F.lit(k) for k in months]))).withColumn("_d", F.add_months("date_ref", -F.col("_m")))
    s = series.select(F.col(key).alias("_k"), F.col(day).cast("date").alias("_sd"), *columns)
    met = wanted.join(s, (F.col(key) == F.col("_k")) & (F.col("_d") == F.col("_sd")), "left")
    return met.groupBy(key, "date_ref").agg(*[F.max(F.when(F.col("_m") == k, F.col(c))).alias(f"{c}_m{k}") for k in months for c in columns])


def daily_mean(series: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """Mean over all entities of each column by day."""
    return series.groupBy(F.col(day).cast("date").alias("day")).agg(*[F.avg(c).alias(c) for c in columns])


def event_relative(events: DataFrame, event_day: str, carried: Sequence[str], daily: DataFrame, columns: Sequence[str], before: int = 30) -> DataFrame:
    """Each event at each day from -before to 0, with that day's mean exposure; rows that lack every column are dropped.

    The daily table has one row a day, so it is joined by broadcast where it is small enough for Spark's own limit.
    """
    spread = events.select(*carried, F.col(event_day).cast("date").alias("_e")).withColumn("rel_day", F.explode(F.sequence(F.lit(-before), F.lit(0)))).withColumn("day", F.date_add("_e", F.col("rel_day")))
    return spread.join(daily, "day", "left").dropna(how="all", subset=list(columns)).select(*carried, F.col("_e").alias("event_day"), "rel_day", *columns)


def event_curve(spread: DataFrame, keys: Sequence[str], columns: Sequence[str], entity: str) -> DataFrame:
    """Median and mean by relative day, and the number of entities."""
    made = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("median", F.median), ("mean", F.avg))]
    return spread.groupBy(*keys, "rel_day").agg(*made, F.countDistinct(entity).alias("n_entities"))


def first_per_entity(events: DataFrame, key: str, day: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(F.col(day).cast("date")).alias("first_day"))


def between_event_days(series: DataFrame, day: str, events: DataFrame, event_day: str, before: int = 30, fallback: tuple[str, str] = ("2017-01-01", "2019-12-31")) -> DataFrame:
    """The series cut to the days that events can reach, as literal bounds that the scan can push down."""
    low, high = events.agg(F.date_sub(F.min(F.col(event_day).cast("date")), before), F.max(F.col(event_day).cast("date"))).first()
    low, high = low or fallback[0], high or fallback[1]
    return series.where((F.col(day) >= F.lit(str(low)).cast("timestamp")) & (F.col(day) < F.date_add(F.lit(str(high)).cast("date"), 1).cast("timestamp")))


def row_lags(series: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], lags: Sequence[int] = (1, 2, 3, 7, 15, 30)) -> DataFrame:
    """Values some rows (not days) before, within each entity."""
    w = Window.partitionBy(key).orderBy(*order)
    return series.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def previous_month(monthly: DataFrame, key: str, year: str, month: str, columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(year, month)
    return monthly.withColumns({f"{c}_before": F.lag(c, 1).over(w) for c in columns})
