"""Case-control study: definition of cases, confounder screen, matching and balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.functions.exprs import require_columns
from cohorta.operators import stats
from cohorta.operators.spatial import nearest
from cohorta.sources.io import kept


def predicate(definition: Mapping, columns: Sequence[str]) -> Column:
    """Conjunction of a dictionary: a scalar is equality, a list membership; unknown columns are skipped, but not all of them."""
    known = {k: v for k, v in definition.items() if k in columns}
    if not known:
        raise ValueError(f"none of {', '.join(definition)} is a column")
    return reduce(lambda a, b: a & b, [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for k, v in known.items()])


def cases_and_controls(df: DataFrame, case: Mapping, control: Mapping | None = None) -> DataFrame:
    """``is_case`` 1 or 0; rows that are neither go where controls are defined."""
    is_case = F.coalesce(predicate(case, df.columns), F.lit(False))
    out = df.withColumn("is_case", is_case.cast("int"))
    return out if control is None else out.where(is_case | predicate(control, df.columns))


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def standardized(df: DataFrame, variables: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numbers standardised with the population deviation, texts one-hot without their first level."""
    made, names = {}, []
    numeric = [v for v in variables if _numeric(df, v)]
    row = df.agg(*[f(v).alias(f"{n}_{v}") for v in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else None
    for v in numeric:
        made[f"_z_{v}"] = F.coalesce((F.col(v) - F.lit(row[f"m_{v}"])) / F.lit(row[f"s_{v}"] or 1.0), F.lit(0.0))
        names.append(f"_z_{v}")
    for v in [v for v in variables if v not in numeric]:
        levels = [r[0] for r in df.select(v).where(F.col(v).isNotNull()).distinct().orderBy(v).collect()]
        for i, level in enumerate(levels[1:]):
            made[f"_h_{v}_{i}"] = F.coalesce((F.col(v) == F.lit(level)).cast("double"), F.lit(0.0))
            names.append(f"_h_{v}_{i}")
    return df.withColumns(made), names


def nearest_case(df: DataFrame, variables: Sequence[str], key: str, date: str) -> DataFrame:
    """Each control's nearest case (the smallest id of equals) in standardised space, with that case's date.

    Exact search over distinct points of the space: equal cases are one point, with their smallest id, and equal
    controls ask once. Points meet by cells of the first two coordinates and a growing radius, never all with all.
    Columns of the result: the input's, ``matched_case_id``, ``matched_control_ids`` (of cases), ``date_reference``.
    """
    require_columns(df, [key, "is_case", date, *variables])
    z, names = standardized(df, variables)
    point = F.array(*[F.col(n) for n in names])
    cases = z.where("is_case = 1").select(F.col(key).alias("_case"), F.col(date).alias("_date"), point.alias("_cv")).groupBy("_cv").agg(F.min(F.struct("_case", "_date")).alias("m"))
    cases = kept(cases.select("_cv", "m._case", "m._date", *[F.col("_cv")[i].alias(f"_c{i}") for i in range(min(2, len(names)))]), "cases")
    controls = z.where("is_case = 0").select(F.col(key).alias(key), point.alias("_v"))
    asked = kept(controls.select("_v").distinct().select("_v", *[F.col("_v")[i].alias(f"_a{i}") for i in range(min(2, len(names)))]), "asked")
    axes = [(f"_a{i}", f"_c{i}") for i in range(min(2, len(names)))]
    gap = F.round(F.aggregate(F.zip_with("_v", "_cv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    sides = [asked.select(a).union(cases.select(c)).agg(F.max(a) - F.min(a)).first()[0] or 0.0 for a, c in axes]
    wide = max([*sides, 1e-9])
    near = nearest(asked, cases, "_v", axes, F.sqrt(gap), [F.col("_case"), F.col("_date")], 2 * wide / max(1.0, cases.count() ** 0.5), 2 * wide)
    best = controls.join(near, "_v").select(key, F.col("best._case").alias("matched_case_id"), F.col("best._date").alias("_date"))
    groups = best.groupBy(F.col("matched_case_id").alias(key)).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col(key)))).alias("matched_control_ids"))
    out = df.join(best, key, "left").join(groups, key, "left")
    return out.withColumn("date_reference", F.when(F.col("is_case") == 1, F.col(date)).otherwise(F.col("_date"))).drop("_date")


def band_cascade(controls: DataFrame, cases: DataFrame, key: str, age: str, exact: Sequence[str], date: str, width: float = 3) -> DataFrame:
    """For each control the case within ``width`` years that agrees in the first exact column if any does, then in the next, then has
    the lowest score (squared age gap plus 100 for each mismatch), then the smallest id. Controls without one get NULL.

    Controls that agree in age and exact columns ask once. For each set of columns that may agree, cases with the same values of
    these and the same age are one, with the smallest id; sorted by age, each control looks only at the next of them below and above.
    So no pairs are made: the work is a sort of these rows, times two to the number of exact columns.
    """
    wide = width * (1 + 1e-9)
    bucket = lambda c: F.floor(c / F.lit(wide))
    ages = F.abs(F.col("_age").cast("double")) < F.lit(float("inf"))
    exact_names = [f"_k_{c}" for c in exact]
    profile = [F.col(age).alias("_age"), *[F.col(c).alias(n) for c, n in zip(exact, exact_names)]]
    # NULL agrees with nothing, so a set that needs a missing value is left out.
    sets = []
    for on in product((True, False), repeat=len(exact)):
        fields = [F.lit(-1 if o else 0).alias(f"a{i}") for i, o in enumerate(on)] + [F.when(F.lit(o), F.col(n)).alias(n) for n, o in zip(exact_names, on)]
        there = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n, o in zip(exact_names, on) if o], F.lit(True))
        sets.append(F.when(there, F.struct(F.lit(0).alias("_"), *fields)))
    spread = lambda df: df.where(ages).withColumn("_set", F.explode(F.array_compact(F.array(*sets))))
    m = F.struct(F.col(key).alias("_case"), F.col(date).alias("_date")).alias("_m")
    c = spread(cases.select(*profile, m)).groupBy("_set", "_age").agg(F.min("_m").alias("_m")).withColumn("_b", F.explode(F.array(*[bucket(F.col("_age")) + i for i in (-1, 0, 1)])))
    k = spread(controls.select(*profile).distinct()).withColumn("_b", bucket(F.col("_age")))
    seen = F.when(F.col("_m").isNotNull(), F.struct("_age", "_m"))
    near = [F.last(seen, ignorenulls=True).over(Window.partitionBy("_set", "_b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.col("_age").asc(), F.col("_age").desc())]
    asked = k.unionByName(c, allowMissingColumns=True).withColumns({"_below": near[0], "_above": near[1]}).where(F.col("_m").isNull())

    def ranked(near: str) -> Column:
        agree = [F.col(f"_set.a{i}") for i in range(len(exact))]
        gap = F.col("_age") - F.col(f"{near}._age")
        score = gap * gap + reduce(lambda a, b: a + b, [(F.lit(1) + a) * 100 for a in agree], F.lit(0))
        return F.when(F.abs(gap) <= width, F.struct(*[a.alias(f"a{i}") for i, a in enumerate(agree)], score.alias("score"), F.col(f"{near}._m._case").alias("_case"), F.col(f"{near}._m._date").alias("_date")))

    asks = [F.col(n).alias(f"_{n}") for n in ("_age", *exact_names)]
    best = asked.select(*asks, F.least(ranked("_below"), ranked("_above")).alias("m")).groupBy(*[f"_{n}" for n in ("_age", *exact_names)]).agg(F.min("m").alias("m"))
    agreed = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in ("_age", *exact_names)])
    best = controls.select(F.col(key), *profile).join(best, agreed).groupBy(key).agg(F.min("m").alias("m"))
    return controls.select(key).join(best, key, "left").select(key, F.col("m._case").alias("matched_case_id"), F.col("m.score").alias("score"), F.col("m._date").alias("date_reference"))


def balance(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], most_mean: float = 2.0, most_share: float = 0.15) -> DataFrame:
    """Difference of cases and controls by variable: of means, or the largest of shares; and whether it is small enough."""
    out = []
    for v in numeric:
        d = df.agg(F.abs(F.avg(F.when(F.col("is_case") == 1, F.col(v))) - F.avg(F.when(F.col("is_case") == 0, F.col(v)))).alias("difference"))
        out.append(d.select(F.lit(v).alias("variable"), F.lit("mean").alias("kind"), "difference", (F.col("difference") <= most_mean).alias("balanced")))
    for v in categories:
        n = df.where(F.col(v).isNotNull()).groupBy(v).agg(F.count_if(F.col("is_case") == 1).alias("a"), F.count_if(F.col("is_case") == 0).alias("b"))
        every = Window.partitionBy(F.lit(1))
        d = n.select((F.abs(F.col("a") / F.sum("a").over(every) - F.col("b") / F.sum("b").over(every))).alias("d")).agg(F.max("d").alias("difference"))
        out.append(d.select(F.lit(v).alias("variable"), F.lit("share").alias("kind"), "difference", (F.col("difference") <= most_share).alias("balanced")))
    return reduce(DataFrame.unionByName, out)


def confounder_screen(df: DataFrame, variables: Sequence[str], outcome: str = "is_case", most_p: float = 0.05, least_effect: float = 0.1) -> DataFrame:
    """Test of each variable's association with the outcome, and whether it is a confounder (p below, effect above)."""
    rows = []
    for v in variables:
        test, stat, p, effect, why = stats.association(df, v, outcome)
        rows.append((v, test, stat, p, effect, bool(p is not None and effect is not None and p < most_p and effect > least_effect), why))
    return df.sparkSession.createDataFrame(rows, "variable string, test string, statistic double, p double, effect double, confounder boolean, note string")


def study(df: DataFrame, case: Mapping, confounders: Sequence[str], key: str, date: str, control: Mapping | None = None, auto: bool = True, manual: Sequence[str] | None = None, default: Sequence[str] = ()) -> dict[str, DataFrame | list[str]]:
    """Definition, screen, match and balance in one: matched rows, the screen, the balance and the variables matched on."""
    labelled = cases_and_controls(df, case, control)
    screen = confounder_screen(labelled, confounders)
    found = [r["variable"] for r in screen.where("confounder").orderBy("variable").collect()] if auto else []
    variables = found or list(manual or default)
    matched = nearest_case(labelled, variables, key, date)
    return {"matched": matched, "screen": screen, "variables": variables, "balance": balance(matched, [v for v in variables if _numeric(df, v)], [v for v in variables if not _numeric(df, v)])}
