"""Evaluation of binary classifiers and analysis of their outcomes, all as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.stats import mann_whitney


def _cells(truth: Column, guess: Column) -> dict[str, Column]:
    return {"tp": F.count_if((truth == 1) & (guess == 1)), "fp": F.count_if((truth == 0) & (guess == 1)), "fn": F.count_if((truth == 1) & (guess == 0)), "tn": F.count_if((truth == 0) & (guess == 0))}


def _rates() -> dict[str, Column]:
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, specificity = zero(c["tp"], c["tp"] + c["fp"]), zero(c["tp"], c["tp"] + c["fn"]), zero(c["tn"], c["tn"] + c["fp"])
    return {
        "accuracy": zero(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]), "precision": precision, "recall": recall, "f1": zero(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2, "youden": recall + specificity - 1,
    }


def confusion_metrics(df: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in _cells(F.col(truth), F.col(guess)).items()]).withColumns(_rates())


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(auc): the share of pairs that the score orders rightly, ties counting half."""
    return mann_whitney(df, score, truth).select("auc")


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """By distinct score, from the highest: positives and rows so far. Summed within range partitions and over their totals."""
    by = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    cut = by.repartitionByRange("s").withColumn("_p", F.spark_partition_id())
    so_far = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_p").agg(F.sum("p").alias("a"), F.sum("n").alias("b")).select("_p", F.coalesce(F.sum("a").over(so_far), F.lit(0)).alias("_a"), F.coalesce(F.sum("b").over(so_far), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy("s")
    return cut.withColumn("_x", F.sum("p").over(inside)).withColumn("_y", F.sum("n").over(inside)).join(F.broadcast(totals), "_p").select((-F.col("s")).alias("score"), "p", "n", (F.col("_a") + F.col("_x")).alias("tp"), (F.col("_b") + F.col("_y")).alias("rows"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(average_precision): the precision at each distinct score, weighted by the recall gained there."""
    return _by_score(df, truth, score).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("rows")), F.sum("p").cast("double")).alias("average_precision"))


def curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Points of the ROC and the precision-recall curve at each distinct score."""
    t = df.where(F.col(score).isNotNull()).agg(F.count_if(F.col(truth) == 1).alias("yes"), F.count_if(F.col(truth) != 1).alias("no"))
    s = _by_score(df, truth, score).crossJoin(F.broadcast(t))
    return s.select("score", (F.col("tp") / F.col("yes")).alias("tpr"), ((F.col("rows") - F.col("tp")) / F.col("no")).alias("fpr"), (F.col("tp") / F.col("rows")).alias("precision"))


def threshold_sweep(df: DataFrame, truth: str, score: str, low: int = 5, high: int = 94, scale: float = 100.0) -> DataFrame:
    """Metrics at each threshold from low/scale to high/scale. Rows are first counted by the thresholds that they reach, so the thresholds are crossed with counts, not rows."""
    reach = F.least(F.floor(F.col(score) * scale + 1e-9), F.lit(high)).cast("int")
    n = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.greatest(reach, F.lit(low - 1)).alias("_k"), F.col(truth).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    at = n.withColumn("step", F.explode(F.sequence(F.lit(low), F.lit(high))))
    hit = F.col("_k") >= F.col("step")
    cell = lambda t, h: F.sum(F.when((F.col("_t") == t) & (hit if h else ~hit), F.col("_n")).otherwise(0))
    out = at.groupBy("step").agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn"))
    return out.withColumn("threshold", F.col("step") / scale).withColumns(_rates()).drop("step")


def best_thresholds(sweep: DataFrame, metrics: Sequence[str] = ("f1", "youden", "balanced_accuracy", "precision", "recall")) -> DataFrame:
    """The first threshold where each metric is highest."""
    row = sweep.agg(*[F.min(F.struct((-F.col(m)).alias("v"), F.col("threshold"))).alias(m) for m in metrics])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.threshold").alias("threshold"), (-F.col(f"{m}.v")).alias("value")) for m in metrics])).alias("x")).select("x.*")


def outcome_label(truth: Column, guess: Column) -> Column:
    return F.when((truth == 1) & (guess == 1), "tp").when((truth == 0) & (guess == 1), "fp").when((truth == 1) & (guess == 0), "fn").when((truth == 0) & (guess == 0), "tn")


def confusion_ids(df: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Ids of each cell as a sorted list, for reports; large analyses use :func:`prediction_quality`, which keeps rows."""
    return df.select(outcome_label(F.col(truth), F.col(guess)).alias("cell"), key).where("cell is not null").groupBy("cell").agg(F.sort_array(F.collect_list(key)).alias("ids"), F.count(F.lit(1)).alias("n"))


def ids_from_metrics(metrics: DataFrame, column: str = "breakdown") -> DataFrame:
    """(strategy, cell, id) from a map of cell to id list; missing lists count as empty."""
    return metrics.select("strategy", F.explode(column).alias("cell", "ids")).select("strategy", "cell", F.explode(F.coalesce("ids", F.array().cast("array<bigint>"))).alias("id"))


def prediction_quality(df: DataFrame, truth: str, guess: str, category: str) -> DataFrame:
    """Well and poorly predicted rows by category, and their shares in %."""
    label = outcome_label(F.col(truth), F.col(guess))
    n = df.where(label.isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(F.count_if(label.isin("tp", "tn")).alias("well"), F.count_if(label.isin("fp", "fn")).alias("poorly"))
    return n.withColumns({"well_pct": F.col("well") * 100.0 / (F.col("well") + F.col("poorly")), "poorly_pct": F.col("poorly") * 100.0 / (F.col("well") + F.col("poorly"))})


def compare_strategies(metrics: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Metrics in long form."""
    return metrics.unpivot([key], list(columns), "metric", "value")
