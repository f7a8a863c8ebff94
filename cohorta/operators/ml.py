"""Imbalanced classification: splits by entity, resampling, forests and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators import evaluate
from cohorta.sources.io import finished

METRICS = "strategy string, accuracy double, precision double, recall double, f1 double, balanced_accuracy double, roc_auc double, average_precision double, error string"
STRATEGIES = ("none", "balanced_forest", "oversample", "undersample", "smote_enn")


def split(df: DataFrame, key: str, shares: Sequence[float] = (0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """Parts with all rows of an id on one side, by a hash of the id; no shuffle, and the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1e6
    edges = [0.0, *np.cumsum(shares).tolist()]
    edges[-1] = 1.0
    return [df.where((u >= lo) & (u < hi)) for lo, hi in zip(edges, edges[1:])]


def fold(key: str, k: int = 5, seed: int = 42):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def preprocessing(numeric: Sequence[str], categories: Sequence[str], strategy: str = "mean") -> list:
    """Imputed and standardised numbers, and one-hot categories that take unseen levels, as ``features``."""
    stages = []
    if numeric:
        stages += [Imputer(inputCols=list(numeric), outputCols=[f"_i_{c}" for c in numeric], strategy=strategy), VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_z", withMean=True)]
    if categories:
        stages += [StringIndexer(inputCols=list(categories), outputCols=[f"_c_{c}" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_c_{c}" for c in categories], outputCols=[f"_h_{c}" for c in categories], handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["_z"] * bool(numeric) + [f"_h_{c}" for c in categories], outputCol="features")]


def _sizes(df: DataFrame, target: str) -> dict[int, int]:
    return {int(r[0]): r[1] for r in df.groupBy(target).count().collect()}


def oversample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Rows of the smaller class repeated until the classes are even: whole repeats, and one more of a hashed share."""
    n = _sizes(df, target)
    small = min(n, key=n.get)
    times = max(n.values()) / n[small]
    extra = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1e6 < times % 1).cast("int")
    reps = F.when(F.col(target) == small, F.lit(int(times)) + extra).otherwise(1)
    return df.withColumn("_r", F.explode(F.sequence(F.lit(1), reps))).drop("_r")


def undersample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """A hashed share of the larger class, to even the classes."""
    n = _sizes(df, target)
    large = max(n, key=n.get)
    keep = min(n.values()) / n[large]
    return df.where((F.col(target) != large) | (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1e6 < keep))


#: Neighbours for SMOTE and ENN are sought within hashed blocks of about this many rows.
BLOCK = 2000


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, each to itself below all others."""
    n = (x * x).sum(axis=1)
    d = np.maximum(n[:, None] + n[None] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, -1)
    return d


def smote_enn(df: DataFrame, features: str, target: str, seed: int = 42, k: int = 5, edited: int = 3) -> DataFrame:
    """Synthetic rows of the smaller class between neighbours, then rows whose neighbours disagree with them go. Works on a vector column, block by block."""
    import pandas as pd

    n = _sizes(df, target)
    small, times = min(n, key=n.get), max(n.values()) / max(1, min(n.values()))
    blocks = max(1, sum(n.values()) // BLOCK)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(part["x"].tolist()), part["y"].to_numpy()
        rng = np.random.default_rng(seed + int(part["b"].iloc[0]))
        own = x[y == small]
        if len(own) > 1:
            d = _squared(own)
            near = np.argsort(d, axis=1)[:, 1 : k + 1]
            at = rng.integers(0, len(own), int(round(len(own) * (times - 1))))
            to = near[at, rng.integers(0, near.shape[1], len(at))]
            x, y = np.vstack([x, own[at] + rng.random((len(at), 1)) * (own[to] - own[at])]), np.append(y, np.full(len(at), small))
        if len(x) > edited:
            d = _squared(x)
            votes = y[np.argsort(d, axis=1)[:, 1 : edited + 1]]
            keep = (votes == y[:, None]).mean(axis=1) > 0.5
            x, y = x[keep], y[keep]
        return pd.DataFrame({"x": x.tolist(), "y": y.astype(float)})

    from pyspark.ml.functions import array_to_vector

    plain = df.select(vector_to_array(features).alias("x"), F.col(target).cast("int").alias("y"))
    plain = plain.withColumn("b", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    made = plain.groupBy("b").applyInPandas(run, "x array<double>, y double")
    return made.select(array_to_vector("x").alias(features), F.col("y").alias(target))


def forest(target: str, trees: int = 100, depth: int = 10, leaf: int = 2, seed: int = 42, weight: str | None = None, least_split: int = 2, subset: str = "auto") -> RandomForestClassifier:
    """A forest. Nodes are split from ``least_split`` rows on: a node of fewer can't give two leaves of half as many, which is what Spark bounds."""
    leaf = max(leaf, least_split // 2)
    f = RandomForestClassifier(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, probabilityCol="_prob", featureSubsetStrategy=subset)
    return f.setWeightCol(weight) if weight else f


def fit_strategy(train: DataFrame, strategy: str, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], **forest_args) -> tuple[PipelineModel, object]:
    """The preprocessor and the forest of one strategy."""
    prep = Pipeline(stages=preprocessing(numeric, categories)).fit(train)
    x = prep.transform(train).withColumn(target, F.col(target).cast("double"))
    weight = None
    if strategy == "oversample":
        x = oversample(x, target, key)
    elif strategy == "undersample":
        x = undersample(x, target, key)
    elif strategy == "smote_enn":
        x = smote_enn(x.select("features", target), "features", target)
    elif strategy == "balanced_forest":
        n = _sizes(x, target)
        total = sum(n.values())
        x = x.withColumn("_w", reduce(lambda c, v: F.when(F.col(target) == v, F.lit(total / (len(n) * n[v]))).otherwise(c), n, F.lit(1.0)))
        weight = "_w"
    elif strategy != "none":
        raise ValueError(f"no strategy {strategy}")
    return prep, forest(target, weight=weight, **forest_args).fit(x)


def scores(prep: PipelineModel, model, df: DataFrame, target: str) -> DataFrame:
    x = model.transform(prep.transform(df))
    return x.withColumns({"score": vector_to_array("_prob")[1], "guess": F.col("prediction").cast("int"), "truth": F.col(target).cast("int")})


def compare(df: DataFrame, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], strategies: Sequence[str] = STRATEGIES, done: Sequence[str] = (), **forest_args) -> DataFrame:
    """Metrics of each strategy on the held-out ids, the best ROC AUC first; ``done`` are skipped, failures are reported and do not stop the others."""
    train, test = split(df, key)
    rows = []
    for s in strategies:
        if s in done:
            continue
        try:
            prep, model = fit_strategy(train, s, target, key, numeric, categories, **forest_args)
            got = scores(prep, model, test, target).select("truth", "guess", "score").cache()
            m = evaluate.confusion_metrics(got, "truth", "guess").first()
            rows.append((s, m["accuracy"], m["precision"], m["recall"], m["f1"], m["balanced_accuracy"], evaluate.roc_auc(got, "truth", "score").first()[0], evaluate.average_precision(got, "truth", "score").first()[0], ""))
            got.unpersist()
        except Exception as e:  # noqa: BLE001
            rows.append((s, *[None] * 7, str(e)[:200]))
    return df.sparkSession.createDataFrame(rows, METRICS).orderBy(F.desc_nulls_last("roc_auc"))


def by_subset(df: DataFrame, column: str, values: Sequence, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on the rows of each value; a value without rows gives one row that says so."""
    out = []
    for v in values:
        part = df.where(F.col(column) == F.lit(v))
        if part.isEmpty():
            out.append(df.sparkSession.createDataFrame([(str(v), "no rows")], "subset string, error string"))
        else:
            out.append(run(part).withColumn("subset", F.lit(str(v))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def random_search(train: DataFrame, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], trials: int = 10, folds: int = 5, seed: int = 42, trees: tuple[int, int] = (50, 501)) -> DataFrame:
    """Random draws of the forest's six parameters, by mean F1 over folds of ids; the best first."""
    rng = np.random.default_rng(seed)
    parts = train.withColumn("_fold", fold(key, folds))
    rows = []
    for _ in range(trials):
        args = {"trees": int(rng.integers(*trees)), "depth": int(rng.integers(3, 11)), "leaf": int(rng.integers(1, 11)), "least_split": int(rng.integers(2, 21)), "subset": str(rng.choice(["sqrt", "log2", "all"]))}
        strategy = str(rng.choice(["none", "balanced_forest"]))
        f1 = []
        for i in range(folds):
            prep, model = fit_strategy(parts.where(F.col("_fold") != i), strategy, target, key, numeric, categories, **args)
            f1.append(evaluate.confusion_metrics(scores(prep, model, parts.where(F.col("_fold") == i), target), "truth", "guess").first()["f1"])
        rows.append((*args.values(), strategy, float(np.mean(f1)), float(np.std(f1))))
    return train.sparkSession.createDataFrame(rows, "trees int, depth int, leaf int, least_split int, subset string, strategy string, f1_mean double, f1_std double").orderBy(F.desc("f1_mean"))


def importances(prep: PipelineModel, model, numeric: Sequence[str], categories: Sequence[str]) -> dict[str, float]:
    """The forest's importances summed over the columns that a source column became, by the encoder's own sizes."""
    values = model.featureImportances.toArray()
    sizes = [(c, 1) for c in numeric]
    encoder = [s for s in prep.stages if hasattr(s, "categorySizes")]
    if encoder:
        sizes += [(c, int(n)) for c, n in zip(categories, encoder[0].categorySizes)]
    out, at = {}, 0
    for c, n in sizes:
        out[c] = float(values[at : at + n].sum())
        at += n
    return out


def permutation_importance(prep: PipelineModel, model, df: DataFrame, target: str, key: str, columns: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Loss of ROC AUC where a column is dealt anew among the rows: (variable, mean, std).

    A column is dealt by joining row numbers with those in a keyed order. Both run over range partitions, so no task holds all rows.
    """
    base = evaluate.roc_auc(scores(prep, model, df, target), "truth", "score").first()[0]

    def numbered(x: DataFrame, order: str, out: str) -> DataFrame:
        cut = x.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
        before = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        return cut.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order))).join(F.broadcast(before), "_p").withColumn(out, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")

    rows = []
    for c in columns:
        losses = []
        for r in range(repeats):
            left = numbered(df.withColumn("_k", F.xxhash64(F.lit(seed), F.col(key))), "_k", "_row").drop("_k", c)
            right = numbered(df.select(c, F.xxhash64(F.lit(seed + r + 1), F.col(key)).alias("_k")), "_k", "_row").drop("_k")
            losses.append(base - evaluate.roc_auc(scores(prep, model, left.join(right, "_row").drop("_row"), target), "truth", "score").first()[0])
        rows.append((c, float(np.mean(losses)), float(np.std(losses))))
    return df.sparkSession.createDataFrame(rows, "variable string, mean double, std double")


def cross_validate(df: DataFrame, strategy: str, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], folds: int = 5, **forest_args) -> DataFrame:
    """(metric, mean, sd) of five metrics over folds of ids, with the population deviation."""
    parts = df.withColumn("_fold", fold(key, folds))
    got = []
    for i in range(folds):
        prep, model = fit_strategy(parts.where(F.col("_fold") != i), strategy, target, key, numeric, categories, **forest_args)
        s = scores(prep, model, parts.where(F.col("_fold") == i), target).select("truth", "guess", "score").cache()
        m = evaluate.confusion_metrics(s, "truth", "guess").first()
        got.append([m["accuracy"], m["precision"], m["recall"], m["f1"], evaluate.roc_auc(s, "truth", "score").first()[0]])
        s.unpersist()
    x = np.array([[np.nan if v is None else v for v in r] for r in got], dtype=float)
    rows = [(name, float(np.nanmean(x[:, i])), float(np.nanstd(x[:, i]))) for i, name in enumerate(("accuracy", "precision", "recall", "f1", "roc_auc")) if not np.isnan(x[:, i]).all()]
    return df.sparkSession.createDataFrame(rows, "metric string, mean double, sd double")


def save_strategy(prep: PipelineModel, model, path: str) -> None:
    """The preprocessor and the forest, in Spark's own format."""
    prep.write().overwrite().save(f"{path}/preprocessor")
    model.write().overwrite().save(f"{path}/forest")


def load_strategy(path: str) -> tuple[PipelineModel, RandomForestClassificationModel]:
    return PipelineModel.load(f"{path}/preprocessor"), RandomForestClassificationModel.load(f"{path}/forest")


def resumable(df: DataFrame, path: str, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], strategies: Sequence[str] = STRATEGIES, **forest_args) -> DataFrame:
    """As :func:`compare`, with the metrics of each strategy added to the JSON state in ``path`` as soon as it is done; strategies that are there are not run again."""
    spark = df.sparkSession
    for s in strategies:
        if s not in finished(spark, path):
            row = compare(df, target, key, numeric, categories, [s], **forest_args)
            if row.first()["error"]:
                raise RuntimeError(f"{s}: {row.first()['error']}")
            row.write.mode("append").json(path)
    return spark.read.schema(METRICS).json(path).where(F.col("strategy").isin(list(strategies))).orderBy(F.desc_nulls_last("roc_auc"))


def learning_curve(df: DataFrame, target: str, key: str, numeric: Sequence[str], categories: Sequence[str], shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), folds: int = 5, **forest_args) -> DataFrame:
    """F1 on training and held-out folds for growing shares of the training rows."""
    parts = df.withColumn("_fold", fold(key, folds))
    rows = []
    for share in shares:
        got = []
        for i in range(folds):
            train = split(parts.where(F.col("_fold") != i), key, (share, 1 - share), seed=7)[0] if share < 1 else parts.where(F.col("_fold") != i)
            prep, model = fit_strategy(train, "none", target, key, numeric, categories, **forest_args)
            got.append([evaluate.confusion_metrics(scores(prep, model, x, target), "truth", "guess").first()["f1"] for x in (train, parts.where(F.col("_fold") == i))])
        rows.append((share, *np.mean(got, axis=0).tolist()))
    return df.sparkSession.createDataFrame(rows, "share double, f1_train double, f1_test double")
