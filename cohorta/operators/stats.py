"""Classical tests: statistics by DataFrame aggregates, p-values from a few numbers on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, chi2_yates, dof, n, min_expected): the statistic without and with Yates' correction (which applies for one degree of freedom only)."""
    from cohorta.operators.cohort import contingency

    cells = contingency(df, a, b)
    d = F.abs(F.col("n") - F.col("expected"))
    fixed = F.greatest(d - 0.5, F.lit(0.0))
    out = cells.agg(
        F.sum(d * d / F.col("expected")).alias("chi2"), F.sum(fixed * fixed / F.col("expected")).alias("y"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"),
        F.sum("n").alias("n"), F.min("expected").alias("min_expected"),
    )
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    return out.select("chi2", F.when(dof == 1, F.col("y")).otherwise(F.col("chi2")).alias("chi2_yates"), dof.alias("dof"), "n", "min_expected")


def pooled_t(df: DataFrame, value: str, group: str) -> DataFrame:
    """(t, dof, effect) of the values where ``group`` is 1 against 0, with pooled variance; the effect is the gap of means over the overall deviation."""
    one, two = (F.when(F.col(group) == g, F.col(value)) for g in (1, 0))
    s = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).agg(
        F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"), F.count(one).alias("n1"), F.count(two).alias("n2"), F.stddev_samp(value).alias("s")
    )
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return s.select(((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("dof"), (F.abs(F.col("m1") - F.col("m2")) / F.col("s")).alias("effect"))


def _ranked(df: DataFrame, value: str, group: str) -> DataFrame:
    """By distinct value: counts of both groups and the mid-rank. Ranks come from the counts of distinct values, summed in two steps:
    within range partitions of the value, and over the totals of those partitions, so that no task sees all values."""
    by = df.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 1).alias("n1"), F.count(F.lit(1)).alias("n"))
    cut = by.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
    totals = cut.groupBy("_p").agg(F.sum("n").alias("t")).withColumn("_before", F.sum("t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    inside = cut.withColumn("_in", F.sum("n").over(Window.partitionBy("_p").orderBy("v")))
    met = inside.join(F.broadcast(totals.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p")
    return met.withColumn("rank", F.col("_before") + F.col("_in") - F.col("n") + (F.col("n") + 1) / 2.0)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """(u, n1, n2, auc, z): U of the group 1 with mid-ranks, and z with tie and continuity corrections."""
    s = _ranked(df, value, group).agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    s = s.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    mean, n = F.col("n1") * F.col("n2") / 2.0, F.col("n").cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = F.abs(F.col("u") - mean)
    return s.select("u", "n1", "n2", F.try_divide(F.col("u"), (F.col("n1") * F.col("n2")).cast("double")).alias("auc"), F.try_divide(F.signum(F.col("u") - mean) * F.greatest(gap - 0.5, F.lit(0.0)), sd).alias("z"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """(r, n, t) of two columns; a 0/1 column gives the point-biserial correlation."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = both.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def association(df: DataFrame, variable: str, outcome: str, least: int = 50, few: int = 10, large: int = 5000) -> tuple[str, float | None, float | None, float | None, str]:
    """(test, statistic, p, effect, note): the test that the variable's type, distinct values and size call for."""
    known = df.where(F.col(variable).isNotNull() & F.col(outcome).isin(0, 1))
    groups = {r[outcome]: r for r in known.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(variable).alias("d")).collect()}
    if sum(r["n"] for r in groups.values()) < least or len(groups) < 2:
        return "none", None, None, None, "too few rows"
    numeric = isinstance(df.schema[variable].dataType, T.NumericType)
    if not numeric or min(r["d"] for r in groups.values()) <= few:
        x = chi2(known, variable, outcome).first()
        note = "" if x["min_expected"] >= 5 else "expected counts below 5"
        return "chi2", x["chi2_yates"], chi2_p(x["chi2_yates"], x["dof"]) if x["dof"] else 1.0, math.sqrt(x["chi2_yates"] / x["n"]), note
    if max(r["n"] for r in groups.values()) > large:
        u = mann_whitney(known, variable, outcome).first()
        m = known.agg(F.median(F.when(F.col(outcome) == 1, F.col(variable))), F.median(F.when(F.col(outcome) == 0, F.col(variable))), F.stddev_samp(variable)).first()
        return "mann-whitney", u["u"], normal_p(u["z"] or 0.0), abs(m[0] - m[1]) / m[2] if m[2] else 0.0, ""
    x = pooled_t(known, variable, outcome).first()
    return "t", x["t"], t_p(x["t"], x["dof"]), x["effect"], ""


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Correlations over complete rows by one aggregate of sums and products, and the number of rows."""
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = full.agg(F.count(F.lit(1)).alias("n"), *[F.corr(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        r[i, j] = r[j, i] = row[f"c{i}_{j}"]
    return r, row["n"]


def kmo_bartlett(r: np.ndarray, n: int) -> tuple[float, float, int, float]:
    """Kaiser-Meyer-Olkin measure, Bartlett's chi2, its degrees of freedom and p."""
    inverse = np.linalg.inv(r)
    d = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(d, d)
    off = ~np.eye(len(r), dtype=bool)
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    p = len(r)
    x = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1]
    return float(kmo), float(x), p * (p - 1) // 2, chi2_p(float(x), p * (p - 1) // 2)


def collinearity_rank(df: DataFrame, columns: Sequence[str]) -> int:
    """Rank of the columns' cross-product matrix."""
    row = df.dropna(subset=list(columns)).agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    x = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            x[i, j] = x[j, i] = row[f"{i}_{j}"]
    return int(np.linalg.matrix_rank(x))


def odds_ratios(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Multivariable logistic regression by maximum likelihood: odds ratio, 95 % interval and Wald p of each column; constant columns are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(outcome).cast("double").alias("_y")).dropna()
    varies = full.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    used = [c for c in columns if varies[c]]
    model = GeneralizedLinearRegression(family="binomial", labelCol="_y", featuresCol="_x").fit(VectorAssembler(inputCols=used, outputCol="_x").transform(full))
    s = model.summary
    rows = [(c, math.exp(b), math.exp(b - 1.959964 * e), math.exp(b + 1.959964 * e), p) for c, b, e, p in zip(used, model.coefficients.toArray().tolist(), s.coefficientStandardErrors, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "variable string, odds_ratio double, low double, high double, p double")


def ridge_logistic(df: DataFrame, columns: Sequence[str], outcome: str, c: float = 1.0) -> DataFrame:
    """(variable, coefficient, odds_ratio) of a logistic regression with a squared penalty of 1 / (2 c) on the summed loss; the intercept is free."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    full = df.select(*[F.col(x).cast("double").alias(x) for x in columns], F.col(outcome).cast("double").alias("_y")).dropna()
    n = full.count()
    model = LogisticRegression(labelCol="_y", featuresCol="_x", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(VectorAssembler(inputCols=list(columns), outputCol="_x").transform(full))
    rows = [(x, float(b), math.exp(b)) for x, b in zip(columns, model.coefficients.toArray().tolist())]
    return df.sparkSession.createDataFrame(rows, "variable string, coefficient double, odds_ratio double")


def univariate_ranking(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """(variable, auc, n), the best first. A logistic model of one variable orders rows as the variable does, or the other way round, so its AUC is
    that of the variable's ranks or its complement; texts are ranked by their place among the sorted values."""
    out = []
    for c in columns:
        x = df.where(F.col(c).isNotNull() & F.col(outcome).isin(0, 1))
        x = x if isinstance(df.schema[c].dataType, T.NumericType) else x.withColumn(c, F.col(c).cast("string"))
        out.append(mann_whitney(x, c, outcome).select(F.lit(c).alias("variable"), F.greatest("auc", 1 - F.col("auc")).alias("auc"), (F.col("n1") + F.col("n2")).alias("n")))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("auc"), "variable")
