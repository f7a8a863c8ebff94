"""All registered queries of the library with the SQL that states their results.

The study's roles are played by the synthetic tables: customers are patients (segment for pathology,
nation for department, balance for a numeric covariate), orders give dates and status, ``events`` is the
daily exposure series, and the first two components of ``embeddings`` are coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions import exprs
from cohorta.operators import cohort, evaluate, exposure, matching, ml, reduce as red, spatial, stats
from cohorta.sources import io
from cohorta.streaming import daily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_table(spark, f"{d}/{name}.parquet")


def _r(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Rounded at the edge, as reports are."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- exposure -------------------------------------------------------------------------------------

_LIMITS = {"EU": {"click": 50.0, "view": 60.0}, "WHO": {"click": 45.0, "purchase": 25.0}}
_COLS = ("click", "view", "purchase")


def _series(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.max(F.when(F.col("event_type") == c, F.col("value"))).alias(c) for c in _COLS])


_SERIES = "s AS (SELECT user_id, ts::DATE AS day, " + ", ".join(f"max(value) FILTER (event_type = '{c}') AS \"{c}\"" for c in _COLS) + " FROM events GROUP BY ALL)"
_REF = "r AS (SELECT user_id, max(ts::DATE) AS date_ref FROM events GROUP BY 1)"


def _refs(spark, d) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("ref"))


def _window_sql() -> str:
    out = []
    for lag in exposure.LAGS:
        inside = f"date_ref - day < {max(lag, 1)}"
        for c in _COLS:
            out.append(f'max("{c}") FILTER ({inside}) AS "max_{c}_J_{lag}"')
            for name, limits in _LIMITS.items():
                if c in limits:
                    n = f'count(*) FILTER ({inside} AND "{c}" > {limits[c]})'
                    out += [f'{n} AS "nb_peaks_{c}_J_{lag}_{name}"', f'({n} > 0)::INT AS "peak_{c}_J_{lag}_{name}"']
    return f"WITH {_SERIES}, {_REF} SELECT r.user_id, date_ref, {', '.join(out)} FROM r LEFT JOIN s ON s.user_id = r.user_id AND day <= date_ref AND day > date_ref - 31 GROUP BY ALL"


@_query(_window_sql())
def exposure_trailing_windows(spark, d):
    return exposure.trailing_windows(_refs(spark, d), _series(spark, d), "user_id", "ref", "day", _COLS, standards=_LIMITS)


@_query(f"WITH {_SERIES}, {_REF} SELECT r.user_id, date_ref, " + ", ".join(f'max("{c}") FILTER (date_ref - day = {k}) AS "{c}_lag_{k}"' for k in (1, 2, 7) for c in _COLS) + " FROM r LEFT JOIN s ON s.user_id = r.user_id AND day BETWEEN date_ref - 7 AND date_ref GROUP BY ALL")
def exposure_point_lags(spark, d):
    return exposure.point_lags(_refs(spark, d), _series(spark, d), "user_id", "ref", "day", _COLS, (1, 2, 7))


_ORDER_DAYS = "o AS (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice) AS spent FROM orders GROUP BY ALL), f AS (SELECT o_custkey, max(day) AS date_ref FROM o GROUP BY 1)"


def _order_days(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("spent"))


@_query(f"WITH {_ORDER_DAYS} SELECT f.o_custkey, date_ref, " + ", ".join(f"round(max(spent) FILTER (day = (date_ref - INTERVAL {k} MONTH)::DATE), 4) AS spent_m{k}" for k in (1, 2, 3)) + " FROM f LEFT JOIN o USING (o_custkey) GROUP BY ALL")
def exposure_month_lags(spark, d):
    o = _order_days(spark, d)
    return _r(exposure.month_lags(o.groupBy("o_custkey").agg(F.max("day").alias("ref")), o, "o_custkey", "ref", "day", ["spent"]), "spent_m1", "spent_m2", "spent_m3")


_CURVE = """
WITH e AS (SELECT user_id, event_type, min(ts::DATE) AS e FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL),
m AS (SELECT ts::DATE AS day, avg(value) AS value FROM events GROUP BY 1),
x AS (SELECT user_id, event_type, e, k::INT AS rel_day, (e + k::INT) AS day FROM e, range(-30, 1) AS g(k))
SELECT event_type, rel_day, round(median(value), 4) AS median_value, round(avg(value), 4) AS mean_value, count(DISTINCT user_id) AS n_entities FROM x JOIN m USING (day) GROUP BY ALL
"""


@_query(_CURVE)
def event_relative_curve(spark, d):
    e = _t(spark, d, "events")
    first = e.where(F.col("event_type").isin("error", "purchase")).groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("e"))
    series = exposure.between_event_days(e, "ts", first, "e")
    spread = exposure.event_relative(first, "e", ["user_id", "event_type"], exposure.daily_mean(series, "ts", ["value"]), ["value"])
    return _r(exposure.event_curve(spread, ["event_type"], ["value"], "user_id"), "median_value", "mean_value")


@_query("SELECT user_id, min(ts::DATE) AS first_day, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' GROUP BY ALL")
def event_first_per_entity(spark, d):
    first = exposure.first_per_entity(_t(spark, d, "events").where("event_type = 'purchase'"), "user_id", "ts")
    return first.join(_t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id")


@_query("WITH o AS (SELECT o_custkey, o_orderdate::DATE AS day, sum(o_totalprice) AS spent FROM orders GROUP BY ALL) SELECT o_custkey, day, round(spent, 4) AS spent, " + ", ".join(f"round(lag(spent, {k}) OVER (PARTITION BY o_custkey ORDER BY day), 4) AS spent_lag_{k}" for k in (1, 2, 3)) + " FROM o")
def row_shift_lags(spark, d):
    return _r(exposure.row_lags(_order_days(spark, d), "o_custkey", ["day"], ["spent"], (1, 2, 3)), "spent", "spent_lag_1", "spent_lag_2", "spent_lag_3")


_MONTHLY = "m AS (SELECT l_suppkey, year(l_shipdate)::INT AS annee, month(l_shipdate)::INT AS mois, avg(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY ALL)"


def _monthly(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("annee"), F.month("l_shipdate").alias("mois")).agg(F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))


@_query(f"WITH {_MONTHLY} SELECT l_suppkey, annee, mois, round(qty, 4) AS qty, round(lag(qty) OVER (PARTITION BY l_suppkey ORDER BY annee, mois), 4) AS qty_before FROM m")
def previous_month_before(spark, d):
    return _r(exposure.previous_month(_monthly(spark, d).drop("disc"), "l_suppkey", "annee", "mois", ["qty"]), "qty", "qty_before")


# ---- cohort ---------------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'oui' WHEN 'O' THEN 'non' ELSE 'non' END"


@_query(f"""
WITH s AS (SELECT o_custkey AS c_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS news, {_STATUS} AS flag, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END DESC NULLS LAST, {_STATUS} DESC) AS k FROM orders),
j AS (SELECT c.c_custkey, coalesce(news, DATE '1999-12-31') AS news, flag FROM customer c JOIN s USING (c_custkey) WHERE k = 1)
SELECT c_custkey, news, flag, CASE WHEN flag = 'oui' AND news > DATE '1999-12-31' THEN 'non' ELSE flag END AS flag_study FROM j WHERE news >= DATE '1997-01-01'
""")
def cohort_status_censoring(spark, d):
    status = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("news"), F.when(F.col("o_orderstatus") == "F", "oui").otherwise("non").alias("flag"))
    return cohort.with_status(_t(spark, d, "customer").select("c_custkey"), status, "c_custkey", "news", "flag", "1997-01-01", "1999-12-31")


@_query(f"WITH {_MONTHLY}, p AS (SELECT l_suppkey, year(l_shipdate)::INT AS annee, count(*) FILTER (l_quantity > 45) AS n_peaks FROM lineitem GROUP BY ALL) SELECT s_suppkey AS l_suppkey, annee, mois, round(qty, 4) AS qty, round(disc, 8) AS disc, n_peaks FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey LEFT JOIN p USING (l_suppkey, annee)")
def cohort_monthly_wide(spark, d):
    yearly = _t(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("annee")).agg(F.count_if(F.col("l_quantity") > 45).alias("n_peaks"))
    base = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return _r(cohort.left_chain(base, [(_monthly(spark, d), ["l_suppkey"]), (yearly, ["l_suppkey", "annee"])]), "qty").withColumn("disc", F.round("disc", 8))


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def cohort_semi(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_mktsegment").join(_t(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")


@_query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def cohort_anti(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_mktsegment").join(_t(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@_query("SELECT c_custkey, (c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error'))::INT AS is_tp FROM customer")
def membership_flag(spark, d):
    ids = _t(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return cohort.membership_flag(_t(spark, d, "customer").select("c_custkey"), ids, "c_custkey", "is_tp")


_DEAD = "p AS (SELECT c.*, n_name, n_regionkey, (c_acctbal < 0)::INT AS dead, (c_custkey % 4 + 1)::INT AS cluster FROM customer c JOIN nation ON c_nationkey = n_nationkey)"


def _patients(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return _t(spark, d, "customer").join(n, "c_nationkey").withColumns({"dead": (F.col("c_acctbal") < 0).cast("int"), "cluster": (F.col("c_custkey") % 4 + 1).cast("int")})


@_query(f"WITH {_DEAD} SELECT n_name, count(*) AS total, sum(dead)::BIGINT AS outcomes, round(sum(dead) * 100.0 / count(*), 4)::DOUBLE AS rate, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM p GROUP BY 1")
def segment_mortality_table(spark, d):
    return _r(cohort.outcome_table(_patients(spark, d), "n_name", "dead"), "rate", "share")


@_query(f"WITH {_DEAD} SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.75), 4) AS q3 FROM p GROUP BY 1")
def segment_numeric_summary(spark, d):
    return _r(cohort.numeric_summary(_patients(spark, d), "c_mktsegment", "c_acctbal"), "mean", "median", "std", "q1", "q3")


@_query(f"WITH {_DEAD} SELECT c_mktsegment, " + ", ".join(f'round(coalesce(avg(dead) FILTER (cluster = {k}), 0) * 100, 4) AS "{k}"' for k in (1, 2, 3, 4)) + " FROM p GROUP BY 1")
def segment_cluster_pivot(spark, d):
    return _r(cohort.rate_pivot(_patients(spark, d), "c_mktsegment", "cluster", [1, 2, 3, 4], "dead"), "1", "2", "3", "4")


_CELLS = f"WITH {_DEAD}, c AS (SELECT a.c_mktsegment, b.cluster, count(p.c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM p) a CROSS JOIN (SELECT DISTINCT cluster FROM p) b LEFT JOIN p ON p.c_mktsegment = a.c_mktsegment AND p.cluster = b.cluster GROUP BY ALL)"


@_query(f"{_CELLS} SELECT c_mktsegment, cluster, n FROM c")
def contingency_counts(spark, d):
    return cohort.contingency(_patients(spark, d), "c_mktsegment", "cluster").select("c_mktsegment", "cluster", "n")


@_query(f"{_CELLS} SELECT c_mktsegment, cluster, round(n * 100.0 / sum(n) OVER (PARTITION BY c_mktsegment), 4)::DOUBLE AS row_pct FROM c")
def contingency_row_pct(spark, d):
    return _r(cohort.contingency(_patients(spark, d), "c_mktsegment", "cluster").select("c_mktsegment", "cluster", "row_pct"), "row_pct")


@_query(f"{_CELLS} SELECT c_mktsegment, cluster, round((sum(n) OVER (PARTITION BY c_mktsegment))::DOUBLE * (sum(n) OVER (PARTITION BY cluster))::DOUBLE / (sum(n) OVER ())::DOUBLE, 4) AS expected FROM c")
def contingency_expected(spark, d):
    return _r(cohort.contingency(_patients(spark, d), "c_mktsegment", "cluster").select("c_mktsegment", "cluster", "expected"), "expected")


@_query(f"WITH {_DEAD} SELECT n_name, " + ", ".join(f"round(count(*) FILTER (cluster = {k}) / count(cluster), 4) AS cluster_{k}" for k in (1, 2, 3, 4)) + " FROM p GROUP BY 1")
def category_share_pivot(spark, d):
    return _r(cohort.share_pivot(_patients(spark, d), "n_name", "cluster", [1, 2, 3, 4], "cluster_"), *[f"cluster_{k}" for k in (1, 2, 3, 4)])


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]]


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in _PAIRS))
def group_correlation(spark, d):
    return _r(cohort.pairwise_correlation(_t(spark, d, "lineitem"), _LINE), "r")


@_query("SELECT user_id, ts::DATE AS day, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def daily_resample_mean(spark, d):
    return _r(cohort.daily_resample(_t(spark, d, "events"), ["user_id"], "ts", "value"), "mean")


@_query("SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL")
def monthly_entity_mean(spark, d):
    return _r(cohort.monthly_mean(_t(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate", "l_quantity"), "mean")


_SEASON = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'Hiver' WHEN month({d}) <= 5 THEN 'Printemps' WHEN month({d}) <= 8 THEN 'Été' ELSE 'Automne' END"
_SY = "(year({d}) + (month({d}) = 12)::INT)::INT"


@_query(f"SELECT l_suppkey, {_SY.format(d='l_shipdate')} AS annee_saison, {_SEASON.format(d='l_shipdate')} AS saison, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL")
def season_mean(spark, d):
    s = F.col("l_shipdate")
    return _r(_t(spark, d, "lineitem").groupBy("l_suppkey", exprs.season_year(s).alias("annee_saison"), exprs.season(s).alias("saison")).agg(F.avg("l_quantity").alias("mean")), "mean")


@_query(f"SELECT {_SY.format(d='o_orderdate')} || ' - ' || {_SEASON.format(d='o_orderdate')} AS label, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def season_outcome_count(spark, d):
    s = F.col("o_orderdate")
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.concat_ws(" - ", exprs.season_year(s), exprs.season(s)).alias("label")).agg(F.countDistinct("o_custkey").alias("n")).orderBy("label")


_TYPES = ("click", "error", "purchase", "signup", "view")


@_query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS cluster_{k}" for k in _TYPES) + " FROM events GROUP BY 1")
def cluster_weight_pivot(spark, d):
    return cohort.weight_pivot(_t(spark, d, "events"), "user_id", "event_type", _TYPES)


@_query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n)
SELECT user_id, max(event_type) FILTER (k = 1) AS dominant, max(n) AS freq, max(total)::BIGINT AS total, round(max(n) * 100.0 / max(total), 4)::DOUBLE AS share, count(*) AS n_distinct, list(event_type ORDER BY event_type) AS visited, round(abs(-sum(n / total * log2(n / total))), 4) AS entropy FROM t GROUP BY 1
""")
def dominant_cluster_entropy(spark, d):
    return _r(cohort.dominant_category(_t(spark, d, "events"), "user_id", "event_type"), "share", "entropy")


@_query("SELECT user_id, month(ts)::INT AS mois, " + ", ".join(f"round(avg((event_type = '{k}')::INT), 4) AS expo_{k}" for k in _TYPES) + " FROM events GROUP BY ALL")
def exposure_flag_mean(spark, d):
    e = _t(spark, d, "events").withColumn("mois", F.month("ts"))
    return _r(cohort.flag_means(e, ["user_id", "mois"], "event_type", _TYPES), *[f"expo_{k}" for k in _TYPES])


def _band_sql(closed: str) -> str:
    e, la = exprs.AGE_EDGES, exprs.AGE_LABELS
    test = (lambda lo, hi: f"a > {lo} AND a <= {hi}") if closed == "right" else (lambda lo, hi: f"a >= {lo} AND a < {hi}")
    return "WITH x AS (SELECT p_partkey, p_size * 3 - 10 AS a FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN {test(lo, hi)} THEN '{name}'" for lo, hi, name in zip(e, e[1:], la)) + " END AS band FROM x"


@_query(_band_sql("right"))
def age_bands_right(spark, d):
    return _t(spark, d, "part").select("p_partkey", exprs.band(F.col("p_size") * 3 - 10).alias("band"))


@_query(_band_sql("left"))
def age_bands_left(spark, d):
    return _t(spark, d, "part").select("p_partkey", exprs.band(F.col("p_size") * 3 - 10, closed="left").alias("band"))


@_query("SELECT o_orderkey, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
def one_hot_reference(spark, d):
    return exprs.one_hot(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "F").drop("o_orderstatus")


@_query("SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer")
def label_encode(spark, d):
    return exprs.label_encode(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "c_mktsegment", F.col("code").cast("int").alias("code"))


@_query("WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS v FROM customer) SELECT c_custkey, round(coalesce(v, (SELECT median(v) FROM x)), 4) AS v FROM x")
def median_impute(spark, d):
    x = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("v"))
    return _r(exprs.impute(x, medians=["v"]), "v")


@_query("WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS v FROM customer) SELECT c_custkey, coalesce(v, (SELECT v FROM x WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v FROM x")
def mode_impute(spark, d):
    x = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("v"))
    return exprs.impute(x, modes=["v"])


@_query("SELECT c_custkey, (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3)::INT AS is_case FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3) OR c_nationkey IN (1, 2)")
def dynamic_case_definition(spark, d):
    return matching.cases_and_controls(_t(spark, d, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3, "unknown": 1}, {"c_nationkey": [1, 2]}).select("c_custkey", "is_case")


@_query("SELECT o_orderkey, CASE WHEN month(o_orderdate) = 3 AND year(o_orderdate) = 1998 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS critical FROM orders")
def critical_state_flag(spark, d):
    o = F.col("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", exprs.critical_state(F.month(o), F.year(o), F.lit("1998-03-15").cast("date"), (F.col("o_orderstatus") == "F").cast("int")).alias("critical"))


@_query(f"WITH {_MONTHLY}, r AS (SELECT l_suppkey, max(l_shipdate)::DATE AS ref FROM lineitem GROUP BY 1) SELECT l_suppkey, annee, mois, CASE WHEN annee = year(ref) AND mois = month(ref) THEN round(qty, 4) END AS qty FROM m JOIN r USING (l_suppkey)")
def null_unless_reference_month(spark, d):
    ref = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("ref"))
    return _r(exprs.only_in_reference_month(_monthly(spark, d).join(ref, "l_suppkey"), ["qty"], "annee", "mois", "ref").drop("ref", "disc"), "qty")


# ---- tests ----------------------------------------------------------------------------------------

_CHI = "WITH n AS ({n}), e AS (SELECT n, sum(n) OVER (PARTITION BY a)::DOUBLE * sum(n) OVER (PARTITION BY b)::DOUBLE / sum(n) OVER ()::DOUBLE AS e FROM n) SELECT round(sum((n - e) ** 2 / e), 4) AS chi2, {extra} FROM e"


@_query(_CHI.format(n=f"{_CELLS} SELECT c_mktsegment AS a, cluster AS b, n FROM c", extra="12 AS dof, sum(n)::BIGINT AS n"))
def chi2_statistic(spark, d):
    return _r(stats.chi2(_patients(spark, d), "c_mktsegment", "cluster").select("chi2", F.col("dof").cast("int").alias("dof"), F.col("n").cast("bigint").alias("n")), "chi2")


@_query(_CHI.format(n="SELECT a, b, count(*) AS n FROM (SELECT (l_returnflag = 'R') AS a, (l_linestatus = 'O') AS b FROM lineitem) GROUP BY ALL", extra="round(sum(greatest(abs(n - e) - 0.5, 0) ** 2 / e), 4) AS chi2_yates"))
def chi2_yates(spark, d):
    x = _t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("a"), (F.col("l_linestatus") == "O").alias("b"))
    return _r(stats.chi2(x, "a", "b").select("chi2", "chi2_yates"), "chi2", "chi2_yates")


@_query("""
WITH g AS (SELECT avg(l_extendedprice) FILTER (y = 1) AS m1, avg(l_extendedprice) FILTER (y = 0) AS m2, var_samp(l_extendedprice) FILTER (y = 1) AS v1, var_samp(l_extendedprice) FILTER (y = 0) AS v2, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n2, stddev_samp(l_extendedprice) AS s
FROM (SELECT l_extendedprice, (l_linestatus = 'O')::INT AS y FROM lineitem))
SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 4) AS t, n1 + n2 - 2 AS dof, round(abs(m1 - m2) / s, 4) AS effect FROM g
""")
def t_statistic(spark, d):
    return _r(stats.pooled_t(_t(spark, d, "lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int")), "l_extendedprice", "y"), "t", "effect")


_RANKED = "WITH x AS (SELECT {v} AS v, {y} AS y FROM {t}), k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x)"


@_query(_RANKED.format(v="l_quantity", y="(l_linestatus = 'O')::INT", t="lineitem") + " SELECT round(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0, 4)::DOUBLE AS u, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n2 FROM k")
def mann_whitney_u(spark, d):
    x = stats.mann_whitney(_t(spark, d, "lineitem").withColumn("y", (F.col("l_linestatus") == "O").cast("int")), "l_quantity", "y")
    return _r(x.select("u", F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2")), "u")


@_query("WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT round(r, 4) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 2) AS t FROM s")
def pearson_t(spark, d):
    return _r(_r(stats.pearson(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "r"), "t", digits=2)


_SCORED = "x AS (SELECT doc_id, toxic AS truth, least(n_chars, 20000) / 20000.0 AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "n_chars", "lang").join(_t(spark, d, "labels"), "doc_id")
    return x.select("doc_id", "lang", F.col("toxic").alias("truth"), (F.least("n_chars", F.lit(20000)) / 20000.0).alias("score")).withColumn("guess", (F.col("score") >= 0.1).cast("int"))


@_query(_RANKED.format(v="n_chars", y="toxic", t="documents JOIN labels USING (doc_id)") + " SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 4)::DOUBLE AS auc FROM k")
def univariate_auc(spark, d):
    return _r(evaluate.roc_auc(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), "toxic", "n_chars"), "auc")


@_query()
def confounder_screen(spark, d):
    p = _patients(spark, d).withColumn("is_case", F.col("dead"))
    return matching.confounder_screen(p, ["c_mktsegment", "cluster", "n_regionkey", "c_nationkey"])


# ---- matching -------------------------------------------------------------------------------------

_PEOPLE = "p AS (SELECT c_custkey AS id, (c_custkey % 60 + 20)::INT AS age, c_mktsegment AS patho, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, (DATE '2019-01-01' + (c_custkey % 300)::INT) AS day, (c_custkey % 10 = 0)::INT AS is_case FROM customer)"


def _people(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(k.alias("id"), (k % 60 + 20).cast("int").alias("age"), F.col("c_mktsegment").alias("patho"), F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"), F.date_add(F.lit("2019-01-01").cast("date"), (k % 300).cast("int")).alias("day"), (k % 10 == 0).cast("int").alias("is_case"))


@_query(f"""
WITH {_PEOPLE}, s AS (SELECT avg(age) AS m, stddev_pop(age) AS s FROM p), z AS (SELECT p.*, (age - m) / s AS za, (sex = 'M')::INT AS zs FROM p, s),
k AS (SELECT a.id, b.id AS m, b.day, row_number() OVER (PARTITION BY a.id ORDER BY round((a.za - b.za) ** 2 + (a.zs - b.zs) ** 2, 9), b.id) AS k FROM z a JOIN z b ON a.is_case = 0 AND b.is_case = 1),
b AS (SELECT id, m, day FROM k WHERE k = 1), g AS (SELECT m AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM b GROUP BY 1)
SELECT p.id, is_case, b.m AS matched_case_id, coalesce(g.ids, NULL) AS matched_control_ids, CASE WHEN is_case = 1 THEN p.day ELSE b.day END AS date_reference FROM p LEFT JOIN b USING (id) LEFT JOIN g USING (id)
""")
def nn_match_standardized(spark, d):
    return matching.nearest_case(_people(spark, d), ["age", "sex"], "id", "day").select("id", "is_case", "matched_case_id", "matched_control_ids", "date_reference")


@_query(f"""
WITH {_PEOPLE}, k AS (
 SELECT a.id, b.id AS m, b.day, (a.age - b.age) ** 2 + 100 * (a.sex <> b.sex)::INT + 100 * (a.patho <> b.patho)::INT AS score, row_number() OVER (PARTITION BY a.id ORDER BY (a.sex = b.sex) DESC, (a.patho = b.patho) DESC, (a.age - b.age) ** 2 + 100 * (a.sex <> b.sex)::INT + 100 * (a.patho <> b.patho)::INT, b.id) AS k
 FROM p a JOIN p b ON a.is_case = 0 AND b.is_case = 1 AND abs(a.age - b.age) <= 3)
SELECT p.id, m AS matched_case_id, score::INT AS score, k.day AS date_reference FROM p LEFT JOIN k ON k.id = p.id AND k.k = 1 WHERE is_case = 0
""")
def band_cascade_match(spark, d):
    p = _people(spark, d)
    return matching.band_cascade(p.where("is_case = 0"), p.where("is_case = 1"), "id", "age", ["sex", "patho"], "day").withColumn("score", F.col("score").cast("int"))


@_query(f"""
WITH {_PEOPLE}, n AS (SELECT patho, count(*) FILTER (is_case = 1) AS a, count(*) FILTER (is_case = 0) AS b FROM p GROUP BY 1), s AS (SELECT max(abs(a / ta - b / tb)) AS x FROM n, (SELECT sum(a) AS ta, sum(b) AS tb FROM n))
SELECT 'age' AS variable, 'mean' AS kind, round(abs(avg(age) FILTER (is_case = 1) - avg(age) FILTER (is_case = 0)), 4) AS difference, abs(avg(age) FILTER (is_case = 1) - avg(age) FILTER (is_case = 0)) <= 2 AS balanced FROM p
UNION ALL SELECT 'patho', 'share', round(x, 4), x <= 0.15 FROM s
""")
def match_balance(spark, d):
    return _r(matching.balance(_people(spark, d), ["age"], ["patho"]), "difference")


# ---- spatial --------------------------------------------------------------------------------------

_PTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 10 + 15 AS t, label FROM embeddings)"


def _points(spark, d):
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (e[0].cast("double") * 1000).alias("x"), (e[1].cast("double") * 1000).alias("y"), (e[2].cast("double") * 10 + 15).alias("t"), "label")


def _stations(spark, d):
    p = _points(spark, d).where("id % 5 = 0")
    return p.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), "t", "label")


_IDW = """k AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, b.t, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.x, b.y) AS k FROM pts a JOIN pts b ON a.id % 5 <> 0 AND b.id % 5 = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 60)"""


@_query(f"WITH {_PTS}, {_IDW}, e AS (SELECT id, count(*) AS n, sum(t / d ** 2) / sum(1 / d ** 2) AS e FROM k WHERE k <= 12 GROUP BY 1) SELECT pts.id, coalesce(n, 0) AS n_neighbors, round(CASE WHEN n >= 3 THEN e END, 4) AS estimate FROM pts LEFT JOIN e USING (id) WHERE id % 5 <> 0")
def idw_interpolate(spark, d):
    targets = _points(spark, d).where("id % 5 != 0").select("id", "x", "y")
    return _r(spatial.idw(targets, _stations(spark, d).drop("id", "label"), ["id"], "t", 60.0).select("id", "n_neighbors", "estimate"), "estimate")


_LEVELS = ((5.0, (2.5, 30.0, 4, 8)), (2.0, (2.0, 45.0, 3, 10)), (None, (1.5, 60.0, 2, 15)))


@_query(f"""
WITH {_PTS}, q AS (SELECT label, count(*) AS n, count(*) / 4.0 AS den FROM pts WHERE id % 5 = 0 GROUP BY 1),
m AS (SELECT label, CASE WHEN den > 5 THEN 2.5 WHEN den > 2 THEN 2.0 ELSE 1.5 END AS p, CASE WHEN den > 5 THEN 30 WHEN den > 2 THEN 45 ELSE 60 END AS r, CASE WHEN den > 5 THEN 4 WHEN den > 2 THEN 3 ELSE 2 END AS lo, CASE WHEN den > 5 THEN 8 WHEN den > 2 THEN 10 ELSE 15 END AS hi FROM q WHERE n >= 2),
k AS (SELECT a.id, b.label, b.t, p, lo, hi, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id, b.label ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.x, b.y) AS k FROM pts a JOIN (pts b JOIN m USING (label)) ON a.id % 5 <> 0 AND b.id % 5 = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= r)
SELECT id, label, count(*) AS n_neighbors, round(CASE WHEN count(*) >= max(lo) THEN least(greatest(sum(t / (d + 10) ** p) / sum(1 / (d + 10) ** p), -25), 60) END, 4) AS estimate FROM k WHERE k <= hi GROUP BY id, label
""")
def idw_adaptive(spark, d):
    targets = _points(spark, d).where("id % 5 != 0").select("id", "x", "y")
    return _r(spatial.idw_adaptive(targets, _stations(spark, d).drop("id"), ["id"], "label", "t", 4.0, levels=_LEVELS), "estimate")


@_query(f"""
WITH {_PTS}, k AS (SELECT a.id, a.id % 5 AS fold, a.t AS truth, b.t, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.x, b.y) AS k FROM pts a JOIN pts b ON a.id % 5 <> b.id % 5 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 50),
e AS (SELECT id, fold, truth, sum(t / d ** 2) / sum(1 / d ** 2) AS e FROM k WHERE k <= 12 GROUP BY ALL HAVING count(*) >= 3)
SELECT fold, round(avg(abs(e - truth)), 4) AS mae, count(*) AS n FROM e GROUP BY 1
""")
def idw_cv_mae(spark, d):
    s = _points(spark, d).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), "t")
    return _r(spatial.idw_cross_validation(s, "id", "t", radius=50.0), "mae")


_GRID = "g AS (SELECT round((x + 400) / 50)::BIGINT AS ix, round((y + 400) / 50)::BIGINT AS iy, avg(t) AS value FROM pts WHERE id % 2 = 0 GROUP BY ALL)"


@_query(f"WITH {_PTS}, {_GRID}, q AS (SELECT id, CASE WHEN x BETWEEN -400 AND 400 AND y BETWEEN -400 AND 400 THEN round((x + 400) / 50)::BIGINT END AS ix, CASE WHEN x BETWEEN -400 AND 400 AND y BETWEEN -400 AND 400 THEN round((y + 400) / 50)::BIGINT END AS iy FROM pts WHERE id % 2 = 1) SELECT id, round(value, 4) AS value FROM q LEFT JOIN g USING (ix, iy)")
def nearest_cell(spark, d):
    p = _points(spark, d)
    cells = p.where("id % 2 = 0").groupBy(F.round((F.col("x") + 400) / 50).cast("long").alias("ix"), F.round((F.col("y") + 400) / 50).cast("long").alias("iy")).agg(F.avg("t").alias("value"))
    return _r(spatial.nearest_cell(p.where("id % 2 = 1").select("id", "x", "y"), cells, "x", "y", -400.0, -400.0, 50.0, 17, 17).select("id", "value"), "value")


@_query(f"""
WITH {_PTS}, q AS (SELECT id, x, y, CASE WHEN id % 3 <> 0 THEN t END AS v FROM pts),
k AS (SELECT a.id, b.v AS f, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.x, b.y) AS k FROM q a JOIN q b ON a.v IS NULL AND b.v IS NOT NULL AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 40)
SELECT q.id, round(coalesce(v, f), 4) AS v FROM q LEFT JOIN k ON k.id = q.id AND k.k = 1
""")
def nearest_fill(spark, d):
    p = _points(spark, d).select("id", "x", "y", F.when(F.col("id") % 3 != 0, F.col("t")).alias("v"))
    return _r(spatial.nearest_fill(p, p.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), "id", "v", 40.0).select("id", "v"), "v")


@_query(f"WITH {_PTS} SELECT id, round(least(greatest(t, 14), 16), 4) AS t FROM pts WHERE x BETWEEN -100 AND 100 AND y BETWEEN -150 AND 150 AND t > 10 AND t < 20")
def bbox_clip_outliers(spark, d):
    p = spatial.bounding_box(_points(spark, d), "y", "x", -150.0, 150.0, -100.0, 100.0).where("t > 10 and t < 20")
    return _r(p.select("id", exprs.clip(F.col("t"), 14.0, 16.0).alias("t")), "t")


_RING = [(-100.0, -100.0), (120.0, -80.0), (60.0, 20.0), (110.0, 130.0), (-90.0, 90.0)]
_CROSS = " + ".join(f"((({y1} > y) <> ({y2} > y)) AND x < {(x2 - x1) / (y2 - y1)!r} * (y - {y1}) + {x1})::INT" for (x1, y1), (x2, y2) in zip(_RING, [*_RING[1:], _RING[0]]))


@_query(f"WITH {_PTS} SELECT id FROM pts WHERE ({_CROSS}) % 2 = 1")
def point_in_polygon(spark, d):
    return spatial.inside_polygon(_points(spark, d), "x", "y", [_RING]).select("id")


_BAND = f"{_PTS}, e AS (SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25), w AS (SELECT i, j, 1 / count(*) OVER (PARTITION BY i) AS w FROM e), z AS (SELECT id, t - (SELECT avg(t) FROM pts) AS z FROM pts), l AS (SELECT z.id, z.z, coalesce(sum(w * zj.z), 0) AS lag FROM z LEFT JOIN w ON w.i = z.id LEFT JOIN z zj ON zj.id = w.j GROUP BY ALL)"


def _band(spark, d):
    p = _points(spark, d)
    return p, spatial.distance_band(p, "id", "x", "y", 25.0)


def _near(spark, d):
    p = _points(spark, d)
    return p, spatial.Band(p, "id", "x", "y", 25.0)


@_query(f"WITH {_BAND} SELECT i, j, round(w, 4) AS w FROM w")
def distance_band_neighbors(spark, d):
    return _r(_band(spark, d)[1].select("i", "j", "w"), "w")


@_query(f"WITH {_BAND} SELECT round((SELECT count(*) FROM pts) / (SELECT sum(w) FROM w) * sum(z * lag) / sum(z * z), 4) AS moran_i, round(-1.0 / (count(*) - 1), 6)::DOUBLE AS expected, count(*) AS n FROM l")
def moran_global(spark, d):
    return _r(_r(spatial.moran_global(*_near(spark, d), "id", "t"), "moran_i"), "expected", digits=6)


@_query(f"WITH {_BAND} SELECT id, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM l")
def moran_local_quadrant(spark, d):
    return spatial.moran_local(*_near(spark, d), "id", "t").select("id", "quadrant")


@_query(f"WITH {_BAND} SELECT round(regr_slope(lag, z), 4) AS slope, round(corr(lag, z), 4) AS r FROM l")
def moran_slope(spark, d):
    return _r(spatial.moran_slope(*_near(spark, d), "id", "t"), "slope", "r")


# ---- evaluation -----------------------------------------------------------------------------------

_RATES = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity,
round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 4) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1, 4) AS youden"""
_CONF = "count(*) FILTER (truth = 1 AND score >= {t}) AS tp, count(*) FILTER (truth = 0 AND score >= {t}) AS fp, count(*) FILTER (truth = 1 AND score < {t}) AS fn, count(*) FILTER (truth = 0 AND score < {t}) AS tn"
_RATE_NAMES = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "youden")


@_query(f"WITH {_SCORED}, c AS (SELECT {_CONF.format(t='0.1')} FROM x) SELECT {_RATES} FROM c")
def confusion_metrics(spark, d):
    return _r(evaluate.confusion_metrics(_scored(spark, d), "truth", "guess"), *_RATE_NAMES)


@_query(_RANKED.format(v="least(n_chars, 20000) / 20000.0", y="toxic", t="documents JOIN labels USING (doc_id)") + " SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 4)::DOUBLE AS auc FROM k")
def roc_auc(spark, d):
    return _r(evaluate.roc_auc(_scored(spark, d), "truth", "score"), "auc")


@_query(f"WITH {_SCORED}, s AS (SELECT score, sum(truth) AS p, count(*) AS n FROM x GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS rows FROM s) SELECT round((sum(p * tp / rows) / sum(p))::DOUBLE, 4) AS average_precision FROM c")
def average_precision(spark, d):
    return _r(evaluate.average_precision(_scored(spark, d), "truth", "score"), "average_precision")


@_query(f"WITH {_SCORED}, h AS (SELECT k / 100.0 AS threshold, x.truth, floor(x.score * 100 + 1e-9) AS s, k FROM x, range(5, 95) AS g(k)), c AS (SELECT threshold, count(*) FILTER (truth = 1 AND s >= k) AS tp, count(*) FILTER (truth = 0 AND s >= k) AS fp, count(*) FILTER (truth = 1 AND s < k) AS fn, count(*) FILTER (truth = 0 AND s < k) AS tn FROM h GROUP BY 1) SELECT threshold::DOUBLE AS threshold, {_RATES} FROM c")
def threshold_sweep(spark, d):
    return _r(evaluate.threshold_sweep(_scored(spark, d), "truth", "score"), *_RATE_NAMES)


_OUT = "CASE WHEN truth = 1 AND score >= 0.1 THEN 'tp' WHEN truth = 0 AND score >= 0.1 THEN 'fp' WHEN truth = 1 THEN 'fn' ELSE 'tn' END"


@_query(f"WITH {_SCORED} SELECT {_OUT} AS cell, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n FROM x GROUP BY 1")
def confusion_id_lists(spark, d):
    return evaluate.confusion_ids(_scored(spark, d), "doc_id", "truth", "guess")


@_query(f"WITH {_SCORED}, l AS (SELECT d.lang, {_OUT} AS o FROM x JOIN documents d USING (doc_id)), n AS (SELECT lang, count(*) FILTER (o IN ('tp', 'tn')) AS well, count(*) FILTER (o IN ('fp', 'fn')) AS poorly FROM l GROUP BY 1) SELECT lang, well, poorly, round(well * 100.0 / (well + poorly), 4)::DOUBLE AS well_pct, round(poorly * 100.0 / (well + poorly), 4)::DOUBLE AS poorly_pct FROM n")
def prediction_quality_shares(spark, d):
    return _r(evaluate.prediction_quality(_scored(spark, d), "truth", "guess", "lang"), "well_pct", "poorly_pct")


@_query("WITH m AS (SELECT c_mktsegment AS strategy, avg(c_acctbal) AS mean, max(c_acctbal) AS top FROM customer GROUP BY 1) SELECT strategy, 'mean' AS metric, round(mean, 4) AS value FROM m UNION ALL SELECT strategy, 'top', round(top, 4) FROM m")
def strategy_unpivot(spark, d):
    m = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("strategy")).agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("top"))
    return _r(evaluate.compare_strategies(m, "strategy", ["mean", "top"]), "value")


@_query(f"WITH c AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}|{b}{chr(39)} AS pair, corr({a}, {b}) AS r FROM lineitem' for a, b in _PAIRS)}) SELECT pair, round(r, 4) AS r FROM c ORDER BY abs(r) DESC LIMIT 3")
def topk_features(spark, d):
    c = cohort.pairwise_correlation(_t(spark, d, "lineitem"), _LINE)
    return _r(c.orderBy(F.abs("r").desc()).limit(3).select(F.concat_ws("|", "a", "b").alias("pair"), "r"), "r")


@_query("SELECT user_id, ts::DATE AS day, round(avg(value), 4) AS mean, max(value) AS max, count(*) FILTER (value > 100) AS n_peaks FROM events GROUP BY ALL")
def daily_exceedance(spark, d):
    return _r(daily.daily_exceedance(_t(spark, d, "events"), "user_id", "ts", "value", 100.0), "mean")


# ---- models (checked by invariants in the tests) --------------------------------------------------

_DIMS = [f"v{i}" for i in range(6)]


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(_DIMS)])


@_query()
def kmo_bartlett(spark, d):
    r, n = stats.correlation_matrix(_t(spark, d, "lineitem"), _LINE)
    kmo, x, dof, p = stats.kmo_bartlett(r, n)
    return spark.createDataFrame([(kmo, x, dof, p)], "kmo double, chi2 double, dof int, p double")


@_query()
def pca_scores(spark, d):
    df, c = red.principal_components(_vectors(spark, d), _DIMS)
    return df.select("vec_id", *[f"PC{k + 1}" for k in range(c.kept)])


@_query()
def kmeans_profiles(spark, d):
    df, c = red.principal_components(_vectors(spark, d), _DIMS)
    pcs = [f"PC{k + 1}" for k in range(c.kept)]
    out, _ = red.cluster(df, pcs, k=4, starts=3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(p).alias(p) for p in pcs])


@_query()
def elbow_k(spark, d):
    costs = red.inertia(_vectors(spark, d), _DIMS, range(2, 8))
    return spark.createDataFrame([(k, float(c), red.elbow([x[0] for x in costs], [x[1] for x in costs])) for k, c in costs], "k int, cost double, elbow int")


@_query()
def logit_odds_ratios(spark, d):
    p = _patients(spark, d)
    x = exprs.one_hot(p, "cluster", [1, 2, 3, 4], 1)
    return stats.odds_ratios(x, ["cluster_2", "cluster_3", "cluster_4", "n_regionkey"], "dead")


def _model_table(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    c = _t(spark, d, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_mktsegment", "n_orders", "avg_price", (F.col("c_acctbal") < 1000).cast("int").alias("y"))


@_query()
def rf_strategies(spark, d):
    return ml.compare(_model_table(spark, d), "y", "c_custkey", ["n_orders", "avg_price"], ["c_mktsegment"], trees=10, depth=4)


@_query()
def permutation_importance(spark, d):
    train, test = ml.split(_model_table(spark, d), "c_custkey")
    prep, model = ml.fit_strategy(train, "none", "y", "c_custkey", ["n_orders", "avg_price"], ["c_mktsegment"], trees=10, depth=4)
    return ml.permutation_importance(prep, model, test, "y", "c_custkey", ["n_orders"], repeats=2)


