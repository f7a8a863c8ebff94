"""More registered queries: column expressions, files, summaries, curves, searches and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions import exprs
from cohorta.operators import cohort, evaluate, ml, spatial, stats
from cohorta.plans.catalog import _model_table, _points, _PTS, _query, _r, _t
from cohorta.sources import io

# ---- column expressions ---------------------------------------------------------------------------


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS or_zero, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS or_null, CASE lower(o_orderstatus) WHEN 'f' THEN 1 WHEN 'o' THEN 0 ELSE 9 END AS mapped FROM orders")
def status_flags(spark, d):
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").select("o_orderkey", exprs.flag_or_zero(s, "F").alias("or_zero"), exprs.flag_or_null(s, "F", "O").alias("or_null"), exprs.flag_by(s, {"f": 1, "o": 0}, 9).alias("mapped"))


@_query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS of_text, count(*) FILTER (o_totalprice > 100000) AS of_flag, count(*) FILTER (o_orderkey % 3 <> 0) AS of_number FROM orders GROUP BY 1")
def outcome_counts(spark, d):
    o = _t(spark, d, "orders").withColumns({"flag": F.col("o_totalprice") > 100000, "number": F.col("o_orderkey") % 3})
    return o.groupBy("o_orderpriority").agg(exprs.outcome_count(o, "o_orderstatus", "F").alias("of_text"), exprs.outcome_count(o, "flag").alias("of_flag"), exprs.outcome_count(o, "number").alias("of_number"))


@_query("""
SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 3 AS months, day(last_day(o_orderdate)) AS days, year(o_orderdate) - 1930 AS age,
 CASE WHEN o_orderkey % 40 BETWEEN 1 AND day(last_day(o_orderdate)) THEN date_trunc('month', o_orderdate)::DATE + (o_orderkey % 40 - 1)::INT END AS parsed FROM orders
""")
def date_parts(spark, d):
    day, at = F.col("o_orderdate"), lambda x: F.lit(x).cast("date")
    text = F.concat(F.date_format(day, "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    return _t(spark, d, "orders").select("o_orderkey", exprs.months_between_whole(day, at("1995-03-31")).cast("long").alias("months"), exprs.days_in_month(day).cast("long").alias("days"), exprs.age(at("1930-07-01"), day).cast("long").alias("age"), exprs.parse_date(text).alias("parsed"))


@_query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice - 273.15, 4) AS celsius, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 4) END AS ratio, round((degrees(atan2(l_tax - 0.041, l_quantity - 25.5)) + 360) % 360, 4) AS angle,
 round(l_quantity * l_discount * l_tax, 4) AS product, round(log2(l_quantity), 4) AS bits, round(exp(l_discount), 4) AS grown, CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS parsed FROM lineitem
""")
def number_forms(spark, d):
    q, t = F.col("l_quantity"), F.col("l_tax")
    out = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", exprs.kelvin_to_celsius(F.col("l_extendedprice")).alias("celsius"), exprs.ratio(t, F.col("l_discount")).alias("ratio"), exprs.angle_degrees(q - 25.5, t - 0.041).alias("angle"),
        exprs.interaction(q, F.col("l_discount"), t).alias("product"), F.log2(q).alias("bits"), F.exp("l_discount").alias("grown"),
        exprs.to_number(F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_returnflag") == "A", "").otherwise("x"))).alias("parsed"),
    )
    return _r(out, "celsius", "ratio", "angle", "product", "bits", "grown")


@_query(r"""
SELECT p_partkey, translate(p_type || ' /\''', ' /\''', '____') AS safe, lower(trim(p_brand)) = 'brand#13' AS same, starts_with(p_brand, 'Brand#1') AS begins,
 CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS rest FROM part
""")
def text_forms(spark, d):
    b = F.col("p_brand")
    return _t(spark, d, "part").select("p_partkey", exprs.safe_name(F.concat("p_type", F.lit(" /\\'"))).alias("safe"), exprs.same_text(b, " BRAND#13 ").alias("same"), b.startswith("Brand#1").alias("begins"), exprs.without_prefix(b, "Brand#").alias("rest"))


# The published constants of Lambert-93 (exponent, C, origin, first eccentricity).
_L93_N, _L93_C, _L93_X, _L93_Y, _L93_E = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, 0.08181919104281579


@_query(f"""
WITH p AS (SELECT c_custkey, (c_custkey % 13 - 4)::DOUBLE AS lon, 42 + (c_custkey % 91) / 10.0 AS lat FROM customer),
l AS (SELECT c_custkey, radians(lon - 3) * {_L93_N} AS a, {_L93_C} * exp(-{_L93_N} * ln(tan(pi() / 4 + radians(lat) / 2) * ((1 - {_L93_E} * sin(radians(lat))) / (1 + {_L93_E} * sin(radians(lat)))) ** ({_L93_E} / 2))) AS r FROM p)
SELECT c_custkey, round({_L93_X} + r * sin(a), 1) AS x, round({_L93_Y} - r * cos(a), 1) AS y FROM l
""")
def lambert93_points(spark, d):
    x, y = exprs.lambert93((F.col("c_custkey") % 13 - 4).cast("double"), 42 + (F.col("c_custkey") % 91) / 10.0)
    return _r(_t(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y")), "x", "y", digits=1)


# ---- files ----------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    path = io.scratch_path(spark, "csv")
    io.write_csv(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return io.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", ";", ["c_custkey", "c_acctbal"])


@_query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_in_chunks(spark, d):
    path, o = io.scratch_path(spark, "chunks"), _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in (0, 1):
        io.write_csv(o.where(F.col("o_orderkey") % 2 == part), path, rows=10_000, append=bool(part))
    read = io.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", ";")
    return _r(read.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


@_query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def rows_of_ids(spark, d):
    ids = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return io.rows_of(io.read_table(spark, f"{d}/orders.parquet", ["o_custkey", "o_orderstatus"]), ids, "o_custkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL")
def months_to_do(spark, d):
    path, o = io.scratch_path(spark, "months"), _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    io.write_monthly(o.where("o_orderdate < '1998-01-01'"), path, "o_orderdate")
    return io.pending_months(o, path, "o_orderdate").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0")
def split_files(spark, d):
    path, c = io.scratch_path(spark, "splits"), _t(spark, d, "customer")
    io.write_splits({"train": c.where("c_custkey % 5 <> 0"), "test": c.where("c_custkey % 5 = 0")}, "c_custkey", path)
    return io.read_split(c, path, "test", "c_custkey").select("c_custkey", "c_name")


@_query("""
WITH x AS (SELECT toxic AS y, n_chars FROM documents JOIN labels USING (doc_id)),
g AS (SELECT 'long' AS strategy, y, (n_chars >= 2000)::INT AS g FROM x UNION ALL SELECT 'short', y, (n_chars < 500)::INT FROM x)
SELECT 'global' AS subset, strategy, round(avg((y = g)::INT), 4) AS accuracy, round(sum(y * g) / sum(g), 4) AS "precision", round(sum(y * g) / sum(y), 4) AS recall FROM g GROUP BY strategy
""")
def metrics_files(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    both = x.select(F.col("toxic").alias("truth"), F.explode(F.array(F.struct(F.lit("long").alias("strategy"), (F.col("n_chars") >= 2000).cast("int").alias("guess")), F.struct(F.lit("short").alias("strategy"), (F.col("n_chars") < 500).cast("int").alias("guess")))).alias("s")).select("truth", "s.*")
    m = evaluate.confusion_metrics(both, "truth", "guess", ["strategy"]).select("strategy", "accuracy", "precision", "recall")
    path = io.scratch_path(spark, "metrics")
    spark.createDataFrame([(io.metrics_document(m),)], "value string").coalesce(1).write.text(path)
    return _r(io.read_metrics(spark, path).select("subset", "strategy", "accuracy", "precision", "recall"), "accuracy", "precision", "recall")


@_query("SELECT to_timestamp(vec_id * 3600)::TIMESTAMP AS time, round(embedding[2]::DOUBLE * 10, 4) AS lat, round(embedding[1]::DOUBLE * 10, 4) AS lon, round(embedding[3]::DOUBLE * 10 + 280 - 273.15, 4) AS value FROM embeddings")
def grid_in_celsius(spark, d):
    v = lambda i: F.col("embedding")[i].cast("double") * 10
    g = _t(spark, d, "embeddings").select(F.timestamp_seconds(F.col("vec_id") * 3600).alias("valid_time"), v(1).alias("latitude"), v(0).alias("longitude"), (v(2) + 280).alias("t2m"))
    return _r(io.tidy_grid(g), "lat", "lon", "value")


# ---- summaries ------------------------------------------------------------------------------------


@_query("""
WITH x AS (SELECT 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT variable, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max, count(DISTINCT v) AS "distinct", count(*) FILTER (v <> 0) AS nonzero
FROM x GROUP BY 1
""")
def describe_numbers(spark, d):
    return _r(cohort.describe(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"]), "mean", "sd")


@_query("SELECT n_regionkey, c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 4)::DOUBLE AS share FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def value_shares(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return _r(cohort.value_counts(_t(spark, d, "customer").join(n, "c_nationkey"), "c_mktsegment", ["n_regionkey"]), "share")


@_query("SELECT min(embedding[1]) AS x_min, min(embedding[2]) AS y_min, max(embedding[1]) AS x_max, max(embedding[2]) AS y_max, count(DISTINCT (embedding[1], embedding[2])) AS points FROM embeddings")
def coordinate_extent(spark, d):
    return cohort.extent(_t(spark, d, "embeddings").select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")), "x", "y")


@_query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) FILTER (event_type <> 'view') AS value FROM events GROUP BY 1")
def last_values(spark, d):
    return cohort.last_values(_t(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value"))), ["user_id"], "event_id", ["event_type", "value"])


@_query("SELECT variable FROM (SELECT 'half' AS variable, avg((c_custkey % 2 <> 0)::INT) AS s FROM customer UNION ALL SELECT 'most', avg((c_custkey % 4 = 0)::INT) FROM customer UNION ALL SELECT 'c_name', 0) WHERE s <= 0.3")
def columns_in_use(spark, d):
    c = _t(spark, d, "customer").withColumns({"half": F.when(F.col("c_custkey") % 2 == 0, 1), "most": F.when(F.col("c_custkey") % 4 != 0, 1)})
    return spark.createDataFrame([(x,) for x in cohort.usable(c, ["half", "most", "c_name"])], "variable string")


@_query("SELECT c_custkey FROM customer WHERE ('0x' || substr(md5('42:' || c_custkey::VARCHAR), 1, 8))::BIGINT < 858993459")
def sampled_ids(spark, d):
    return cohort.hashed_sample(_t(spark, d, "customer"), "c_custkey", 0.2).select("c_custkey")


@_query("SELECT DISTINCT l_discount AS p, CASE WHEN l_discount < 0.001 THEN '***' WHEN l_discount < 0.01 THEN '**' WHEN l_discount < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem")
def significance_stars(spark, d):
    return spark.createDataFrame([(r[0], stats.stars(r[0])) for r in _t(spark, d, "lineitem").select("l_discount").distinct().collect()], "p double, stars string")


# ---- curves and rankings --------------------------------------------------------------------------


@_query("""
WITH k AS (SELECT n_chars AS score, sum(toxic)::DOUBLE AS p, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS r FROM k), t AS (SELECT sum(p) AS yes, sum(n - p) AS no FROM k)
SELECT score, round(tp / yes, 4) AS tpr, round((r - tp) / no, 4) AS fpr, round(tp / r, 4) AS "precision" FROM c, t
""")
def curve_points(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return _r(evaluate.curve(x, "toxic", "n_chars"), "tpr", "fpr", "precision")


_AUC = "SELECT '{v}' AS variable, greatest(a, 1 - a) AS auc, n FROM (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS a, count(*) AS n FROM (SELECT toxic AS y, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)))"


@_query(f"WITH a AS ({' UNION ALL '.join(_AUC.format(v=v) for v in ('n_chars', 'quality', 'lang'))}) SELECT variable, round(auc, 4)::DOUBLE AS auc, n FROM a")
def variable_ranking(spark, d):
    return _r(stats.univariate_ranking(_t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id"), ["n_chars", "quality", "lang"], "toxic"), "auc")


@_query(f"""
WITH {_PTS}, q AS (SELECT id, x, y, CASE WHEN id % 5 = 0 THEN t END AS v FROM pts),
k AS (SELECT a.id, b.v AS f, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.x, b.y) AS k FROM q a JOIN q b ON a.v IS NULL AND b.v IS NOT NULL)
SELECT q.id, round(coalesce(v, f), 4) AS v FROM q LEFT JOIN k ON k.id = q.id AND k.k = 1
""")
def nearest_fill_any(spark, d):
    p = _points(spark, d).select("id", "x", "y", F.when(F.col("id") % 5 == 0, F.col("t")).alias("v"))
    return _r(spatial.nearest_fill(p, p.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), "id", "v").select("id", "v"), "v")


@_query("SELECT ix, iy, 1 + ix * 2.5 AS x, 2 + iy * 2.5 AS y FROM range(4) a(ix), range(3) b(iy)")
def regular_grid(spark, d):
    return spatial.grid(spark, 1.0, 2.0, 11.0, 8.0, 2.5)


# ---- models (checked by invariants in the tests) --------------------------------------------------

_NUM, _CAT = ["n_orders", "avg_price"], ["c_mktsegment"]


@_query()
def ridge_odds_ratios(spark, d):
    return stats.ridge_logistic(_model_table(spark, d).withColumn("price", F.col("avg_price") / 1e5), ["n_orders", "price"], "y")


@_query()
def cross_validation(spark, d):
    return ml.cross_validate(_model_table(spark, d), "none", "y", "c_custkey", _NUM, _CAT, folds=3, trees=10, depth=4)


@_query()
def parameter_search(spark, d):
    return ml.random_search(_model_table(spark, d), "y", "c_custkey", _NUM, _CAT, trials=2, folds=2, trees=(5, 16))


@_query()
def learning_curve(spark, d):
    return ml.learning_curve(_model_table(spark, d), "y", "c_custkey", _NUM, _CAT, shares=(0.5, 1.0), folds=2, trees=10, depth=4)


@_query()
def resumed_strategies(spark, d):
    path, table = io.scratch_path(spark, "state"), _model_table(spark, d)
    ml.resumable(table, path, "y", "c_custkey", _NUM, _CAT, ["none"], trees=10, depth=4)
    return ml.resumable(table, path, "y", "c_custkey", _NUM, _CAT, ["none", "undersample"], trees=10, depth=4)


@_query()
def stored_model_importances(spark, d):
    path = io.scratch_path(spark, "model")
    ml.save_strategy(*ml.fit_strategy(_model_table(spark, d), "none", "y", "c_custkey", _NUM, _CAT, trees=10, depth=4), path)
    return spark.createDataFrame(list(ml.importances(*ml.load_strategy(path), _NUM, _CAT).items()), "variable string, importance double")


@_query()
def moran_local_tested(spark, d):
    p = _points(spark, d)
    return spatial.moran_local_tested(p, spatial.Band(p, "id", "x", "y", 40.0), "id", "t")
