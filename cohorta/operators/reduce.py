"""Principal components, k-means profiles and the elbow rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.operators.stats import correlation_matrix, kmo_bartlett


@dataclass
class Components:
    """Loadings (variables by components), explained shares, and the means and deviations of the variables."""

    variables: list[str]
    loadings: np.ndarray
    ratios: np.ndarray
    means: list[float]
    deviations: list[float]
    kept: int
    kmo: float
    bartlett: float

    def table(self, df: DataFrame) -> DataFrame:
        """(variable, component, loading, cos2, contribution); the contribution is cos2 in % over the component's share."""
        rows = [(v, f"PC{k + 1}", float(self.loadings[i, k]), float(self.cos(i, k) ** 2), float(self.cos(i, k) ** 2 * 100 / self.ratios[k])) for i, v in enumerate(self.variables) for k in range(self.kept)]
        return df.sparkSession.createDataFrame(rows, "variable string, component string, loading double, cos2 double, contribution double")

    def cos(self, i: int, k: int) -> float:
        """Correlation of a variable with a component."""
        return self.loadings[i, k] * np.sqrt(self.ratios[k] * len(self.variables))

    def groups(self, df: DataFrame, a: int = 0, b: int = 1, mixed_below: float = 0.7) -> DataFrame:
        """Each variable's place in the plane of two components: distance, angle, sector, quality, and the component that it belongs to."""
        rows = []
        for i, v in enumerate(self.variables):
            x, y = self.cos(i, a), self.cos(i, b)
            angle = float(np.degrees(np.arctan2(y, x)) % 360)
            sector = "right" if angle >= 315 or angle < 45 else "up" if angle < 135 else "left" if angle < 225 else "down"
            q, big = x * x + y * y, max(abs(x), abs(y))
            own = "mixed" if big == 0 or min(abs(x), abs(y)) / big > mixed_below else f"PC{a + 1}" if abs(x) > abs(y) else f"PC{b + 1}"
            rows.append((v, float(x), float(y), float(np.hypot(x, y)), angle, sector, float(q), "good" if q > 0.5 else "fair" if q > 0.3 else "poor", own))
        return df.sparkSession.createDataFrame(rows, "variable string, x double, y double, distance double, angle double, sector string, cos2 double, quality string, component string")

    def top(self, n: int = 20, method: str = "loadings") -> list[str]:
        """Variables with the largest sums of absolute loadings, of cos2, or of contributions over the kept components."""
        ks = range(self.kept)
        score = {"loadings": lambda i: sum(abs(self.loadings[i, k]) for k in ks), "cos2": lambda i: sum(self.cos(i, k) ** 2 for k in ks), "contributions": lambda i: sum(self.cos(i, k) ** 2 / self.ratios[k] for k in ks)}[method]
        return [self.variables[i] for i in sorted(range(len(self.variables)), key=lambda i: (-score(i), i))[:n]]


def principal_components(df: DataFrame, variables: Sequence[str], explained: float = 0.99) -> tuple[DataFrame, Components]:
    """Rows without NULLs and their component scores, PC1 to the first that reaches the explained share.

    Only the correlation matrix comes to the driver; the scores are expressions. The largest loading of each component is positive.
    """
    full = df.dropna(subset=list(variables))
    r, n = correlation_matrix(full, variables)
    row = full.agg(*[f(c).alias(f"{k}_{c}") for c in variables for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    ratios = values / values.sum()
    kept = int(np.argmax(np.cumsum(ratios) >= min(explained, np.cumsum(ratios)[-1] - 1e-12)) + 1)
    kmo, x, _, _ = kmo_bartlett(r, n)
    c = Components(list(variables), vectors, ratios, [row[f"m_{v}"] for v in variables], [row[f"s_{v}"] or 1.0 for v in variables], kept, kmo, x)
    score = lambda k: sum(((F.col(v) - F.lit(m)) / F.lit(s) * F.lit(float(vectors[i, k])) for i, (v, m, s) in enumerate(zip(c.variables, c.means, c.deviations))), F.lit(0.0))
    return full.withColumns({f"PC{k + 1}": score(k) for k in range(kept)}), c


def elbow(ks: Sequence[int], costs: Sequence[float], fallback: int = 3) -> int:
    """The knee of a convex, decreasing curve (Satopää et al., 2011): where the normalised difference curve peaks."""
    x, y = np.array(ks, float), np.array(costs, float)
    if len(x) < 3 or np.ptp(y) == 0:
        return fallback
    gap = (1 - (y - y.min()) / np.ptp(y)) - (x - x.min()) / np.ptp(x)
    peaks = [i for i in range(1, len(x) - 1) if gap[i] >= gap[i - 1] and gap[i] >= gap[i + 1]]
    return int(x[max(peaks, key=lambda i: gap[i])]) if peaks else fallback


def inertia(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 13), seed: int = 42) -> list[tuple[int, float]]:
    x = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df).select("_x").cache()
    out = [(k, KMeans(k=k, seed=seed, featuresCol="_x").fit(x).summary.trainingCost) for k in ks]
    x.unpersist()
    return out


def cluster(df: DataFrame, columns: Sequence[str], k: int | None = None, ks: Sequence[int] = range(2, 13), seed: int = 42, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows with ``cluster`` (1 to k, in the order of the centres' first component) and the centres; the best of some starts, k by the elbow where it is not given."""
    if k is None:
        costs = inertia(df, columns, ks, seed)
        k = elbow([c[0] for c in costs], [c[1] for c in costs])
    x = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df)
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_x", predictionCol="_c").fit(x) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = [c.tolist() for c in best.clusterCenters()]
    rank = {old: new + 1 for new, old in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    name = F.element_at(F.array(*[F.lit(rank[i]) for i in range(len(centres))]), F.col("_c") + 1)
    spark = df.sparkSession
    table = spark.createDataFrame([(rank[i], *map(float, c)) for i, c in enumerate(centres)], "cluster int, " + ", ".join(f"{c} double" for c in columns))
    return best.transform(x).withColumn("cluster", name).drop("_x", "_c"), table


def pollution_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first component of mean-imputed, centred, unscaled columns as ``index``."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    z = df.withColumns({f"_i_{c}": F.coalesce(F.col(c), F.lit(row[c])) - F.lit(row[c]) for c in columns})
    cov = z.agg(*[F.avg(F.col(f"_i_{a}") * F.col(f"_i_{b}")).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    s = np.array([[cov[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    v = np.linalg.eigh(s)[1][:, -1]
    v = v * np.sign(v[np.abs(v).argmax()])
    return z.withColumn("index", sum((F.col(f"_i_{c}") * F.lit(float(v[i])) for i, c in enumerate(columns)), F.lit(0.0))).drop(*[f"_i_{c}" for c in columns])


def vector_columns(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """A vector column as plain columns."""
    a = vector_to_array(column)
    return df.withColumns({n: a[i] for i, n in enumerate(names)})
