"""Daily exposure of a stream: tumbling one-day means and exceedance counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_exceedance(stream: DataFrame, key: str, ts: str, value: str, limit: float, late: str = "2 days") -> DataFrame:
    """By entity and day: mean, maximum and rows above the limit; days close when the watermark passes them."""
    w = F.window(ts, "1 day")
    by = stream.withWatermark(ts, late).groupBy(key, w.alias("w")) if stream.isStreaming else stream.groupBy(key, w.alias("w"))
    return by.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count_if(F.col(value) > limit).alias("n_peaks")).select(key, F.col("w.start").cast("date").alias("day"), "mean", "max", "n_peaks")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
