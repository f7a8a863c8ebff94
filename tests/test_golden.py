"""Hand-sized cases of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.functions import exprs
from cohorta.operators import cohort, evaluate, exposure, matching, ml, reduce, spatial, stats
from cohorta.sources import io
from cohorta.streaming import daily

D = dt.date.fromisoformat


def test_trailing_windows(spark):
    e = spark.createDataFrame([(1, D("2019-03-10")), (2, D("2019-03-10"))], "id long, ref date")
    s = spark.createDataFrame([(1, D("2019-03-10"), 40.0), (1, D("2019-03-09"), 60.0), (1, D("2019-03-08"), None), (1, D("2019-03-04"), 55.0), (1, D("2019-02-28"), 51.0), (1, D("2019-03-11"), 900.0)], "id long, day date, PM10 double")
    rows = {r["id"]: r for r in exposure.trailing_windows(e, s, "id", "ref", "day", ["PM10"]).collect()}
    assert [rows[1][f"max_PM10_J_{k}"] for k in (0, 1, 2, 3, 7, 15)] == [40, 40, 60, 60, 60, 60]
    assert [rows[1][f"nb_peaks_PM10_J_{k}_EU"] for k in (0, 1, 2, 3, 7, 15)] == [0, 0, 1, 1, 2, 3]
    assert rows[2]["max_PM10_J_31"] is None and rows[2]["nb_peaks_PM10_J_31_EU"] == 0 and rows[2]["peak_PM10_J_31_WHO"] == 0


def test_nan_and_strict_limit(spark):
    s = exprs.nan_to_null(spark.createDataFrame([(1, D("2019-03-10"), float("nan")), (2, D("2019-03-10"), 50.0)], "id long, day date, PM10 double"))
    e = s.select("id", F.col("day").alias("ref"))
    rows = {r["id"]: r for r in exposure.trailing_windows(e, s, "id", "ref", "day", ["PM10"], lags=(1,)).collect()}
    assert rows[1]["max_PM10_J_1"] is None and rows[1]["nb_peaks_PM10_J_1_EU"] == 0
    assert rows[2]["peak_PM10_J_1_EU"] == 0 and rows[2]["peak_PM10_J_1_WHO"] == 1


def test_seasons_bands_and_status(spark):
    d = spark.createDataFrame([(D("2018-12-15"),), (D("2019-02-01"),), (D("2019-06-30"),)], "d date")
    assert [tuple(r) for r in d.select(exprs.season(F.col("d")), exprs.season_year(F.col("d"))).collect()] == [("Hiver", 2019), ("Hiver", 2019), ("Été", 2019)]
    a = spark.createDataFrame([(0,), (35,), (36,), (120,), (121,), (119,)], "a int")
    assert [r[0] for r in a.select(exprs.band(F.col("a"))).collect()] == [None, "0-35", "36-50", "81+", None, "81+"]
    assert [r[0] for r in a.select(exprs.band(F.col("a"), closed="left")).collect()] == ["0-35", "36-50", "36-50", None, None, "81+"]
    s = spark.createDataFrame([(D("2020-05-01"), "oui"), (D("2019-12-31"), "oui"), (None, "non")], "d date, s string")
    assert [r[0] for r in s.select(exprs.censored_status(F.col("s"), F.col("d"), "2019-12-31")).collect()] == ["non", "oui", "non"]


def test_dominant_category(spark):
    df = spark.createDataFrame([(1, c) for c in (2, 1, 1, 3, 1, 2)] + [(2, 2), (2, 1)], "id long, c int")
    rows = {r["id"]: r for r in cohort.dominant_category(df, "id", "c").collect()}
    assert (rows[1]["dominant"], rows[1]["freq"], rows[1]["total"], rows[1]["share"], rows[1]["n_distinct"], rows[1]["visited"]) == (1, 3, 6, 50.0, 3, [1, 2, 3])
    assert rows[1]["entropy"] == pytest.approx(1.4591479170272448) and rows[2]["dominant"] == 1


def test_tests(spark):
    x = spark.createDataFrame([(a, b) for a, b, n in ((0, 0, 10), (0, 1, 5), (1, 0, 3), (1, 1, 12)) for _ in range(n)], "a int, b int")
    r = stats.chi2(x, "a", "b").first()
    assert r["chi2"] == pytest.approx(6.651583710407239) and r["chi2_yates"] == pytest.approx(4.886877828054299) and r["min_expected"] == 6.5
    assert stats.chi2_p(7.814727903251178, 3) == pytest.approx(0.05) and stats.chi2_p(187.01446745737496, 3) < 1e-30
    v = spark.createDataFrame([(1, float(k)) for k in (1, 2, 3, 4, 5)] + [(0, float(k)) for k in (3, 4, 5, 6, 9)], "g int, v double")
    t = stats.pooled_t(v, "v", "g").first()
    assert t["t"] == pytest.approx(-1.921537845661046) and t["dof"] == 8 and stats.t_p(t["t"], 8) == pytest.approx(0.0909, abs=2e-4)
    assert stats.mann_whitney(v, "v", "g").first()["u"] == 4.5
    r = np.array([[1, 0.6, 0.4], [0.6, 1, 0.5], [0.4, 0.5, 1]])
    kmo, chi, dof, _ = stats.kmo_bartlett(r, 100)
    assert (kmo, chi, dof) == (pytest.approx(0.657812884033528), pytest.approx(73.36302277234884), 3)


def test_auc_and_precision(spark):
    s = spark.createDataFrame(list(zip((1, 0, 1, 1, 0, 0), (0.9, 0.8, 0.7, 0.4, 0.3, 0.2))), "y int, s double")
    assert evaluate.roc_auc(s, "y", "s").first()[0] == pytest.approx(0.7777777777777778)
    assert evaluate.average_precision(s, "y", "s").first()[0] == pytest.approx(0.8055555555555556)
    best = {r["metric"]: r for r in evaluate.best_thresholds(evaluate.threshold_sweep(s, "y", "s")).collect()}
    assert best["f1"]["value"] == pytest.approx(6 / 7)


def test_idw(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    s = spark.createDataFrame([(1000.0, 0.0, 10.0), (0.0, 2000.0, 20.0), (-4000.0, 0.0, 30.0)], "sx double, sy double, v double")
    assert spatial.idw(t, s, ["id"], "v", 5000.0).first()["estimate"] == pytest.approx(12.857142857142856)
    assert spatial.idw(t, s, ["id"], "v", 5000.0, power=1.5, smoothing=10.0).first()["estimate"] == pytest.approx(14.107686853246198)
    assert spatial.idw(t, s, ["id"], "v", 2500.0).first()["estimate"] is None
    assert spatial.idw(spark.createDataFrame([(1, 1000.0, 0.0)], "id long, x double, y double"), s, ["id"], "v", 9000.0).first()["estimate"] == 10.0


def test_moran_of_a_path(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, v) for i, v in enumerate((1.0, 1.0, 0.0, 0.0))], "id long, x double, y double, v double")
    w = spatial.distance_band(p, "id", "x", "y", 1.0)
    r = spatial.moran_global(p, w, "id", "v").first()
    assert r["moran_i"] == pytest.approx(0.5) and r["expected"] == pytest.approx(-1 / 3)
    assert [x["lag"] for x in spatial.spatial_lag(p, w, "id", "v").orderBy("id").collect()] == pytest.approx([0.5, 0, 0, -0.5])
    flat = p.withColumn("v", F.lit(1.0))
    assert spatial.moran_global(flat, w, "id", "v").first()["moran_i"] is None
    assert 0 < spatial.moran_permutations(p, w, "id", "v", 19).first()["p"] <= 1


def test_projection_and_interpolation(spark):
    r = spark.createDataFrame([(3.0, 46.5), (2.3522, 48.8566)], "lon double, lat double").select(*exprs.lambert93(F.col("lon"), F.col("lat"))).collect()
    assert tuple(r[0]) == pytest.approx((700000, 6600000), abs=1e-3) and tuple(r[1]) == pytest.approx((652469, 6862035), abs=2)
    st = spark.createDataFrame([(1, x, y, 2 * x + 3 * y) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (4.0, 4.0))], "day int, sx double, sy double, v double")
    t = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0)], "x double, y double")
    assert sorted(r["estimate"] for r in spatial.linear_interpolation(t, st, "day", "v").collect()) == pytest.approx([5.0, 12.0])
    g = spatial.grid(spark, 0, 0, 3, 2, 1.0).withColumn("v", F.lit(2.0))
    assert all(abs(r["v"] - 2) < 1e-9 for r in spatial.gaussian_smooth(g, "ix", "iy", "v", 1.0).collect()) and g.count() == 6


def test_matching(spark):
    cases = spark.createDataFrame([(1, 50, "M", "Sein", D("2018-01-01")), (2, 53, "F", "Thorax", D("2018-02-01")), (3, 54, "F", "Sein", D("2018-03-01"))], "id long, age int, sex string, patho string, d date")
    controls = spark.createDataFrame([(10, 50, "F", "Sein"), (11, 90, "F", "Sein")], "id long, age int, sex string, patho string")
    got = {r["id"]: r for r in matching.band_cascade(controls, cases, "id", "age", ["sex", "patho"], "d").collect()}
    assert got[10]["matched_case_id"] == 2 and got[10]["score"] == 109 and got[11]["matched_case_id"] is None and got[11]["date_reference"] is None
    with pytest.raises(ValueError):
        matching.predicate({"nothing": 1}, ["a"])


def test_study(spark):
    p = spark.range(200).select(F.col("id"), (F.col("id") % 50 + 20 + F.when(F.col("id") % 5 == 0, 15).otherwise(0)).cast("int").alias("age"), F.when(F.col("id") % 3 == 0, "M").otherwise("F").alias("sex"), (F.col("id") % 5 == 0).cast("int").alias("dead"), F.lit(D("2018-01-01")).alias("day"))
    out = matching.study(p, {"dead": 1}, ["age", "sex"], "id", "day", default=["age"])
    assert out["variables"] and out["matched"].where("is_case = 0 and matched_case_id is null").isEmpty()
    assert out["matched"].count() == 200 and out["balance"].count() == len(out["variables"])


def test_components_and_clusters(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    df = spark.createDataFrame([(float(x), float(2 * x + e), float(z)) for x, e, z in zip(a, rng.normal(size=300) * 0.1, rng.normal(size=300))], "a double, b double, c double")
    scores, c = reduce.principal_components(df, ["a", "b", "c"], 0.9)
    assert c.kept == 2 and c.ratios.sum() == pytest.approx(1)
    assert scores.agg(F.var_pop("PC1")).first()[0] == pytest.approx(c.ratios[0] * 3, rel=1e-6)
    assert {r["component"] for r in c.table(df).collect()} == {"PC1", "PC2"} and c.groups(df).count() == 3 and len(c.top(2)) == 2
    got, centres = reduce.cluster(scores, ["PC1", "PC2"], k=3, starts=2)
    assert {r[0] for r in got.select("cluster").distinct().collect()} == {1, 2, 3} and centres.count() == 3
    assert reduce.elbow([2, 3, 4, 5, 6], [100, 40, 35, 32, 30]) == 3
    assert reduce.pollution_index(df, ["a", "b"]).agg(F.avg("index")).first()[0] == pytest.approx(0, abs=1e-9)


def test_splits_and_resampling(spark):
    df = spark.range(2000).select((F.col("id") % 400).alias("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a, b = ml.split(df, "id")
    assert a.count() + b.count() == 2000 and a.join(b, "id", "left_semi").isEmpty()
    n = {r["y"]: r["count"] for r in ml.oversample(df, "y", "id").groupBy("y").count().collect()}
    assert n[0] == n[1] == 1800
    n = {r["y"]: r["count"] for r in ml.undersample(df, "y", "id").groupBy("y").count().collect()}
    assert n[1] == 200 and n[0] < 400


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id;codepost;v\n1;01000;2.5\n2;75001;NaN\n")
    p = io.read_csv(spark, str(tmp_path / "p.csv"), "id long, codepost string, v double", ";")
    assert [tuple(r) for r in p.orderBy("id").collect()] == [(1, "01000", 2.5), (2, "75001", None)]
    days = spark.createDataFrame([(1, D("2019-01-05")), (2, D("2019-02-05"))], "id long, day date")
    out = str(tmp_path / "m")
    assert io.pending_months(days, out, "day").count() == 2
    io.write_monthly(days.where("id = 1"), out, "day")
    assert [r["id"] for r in io.pending_months(days, out, "day").collect()] == [2]
    (tmp_path / "m.json").write_text('{"global": {"none": {"accuracy": 0.5, "patient_classification_breakdown": {"tp": [1, 2]}}}}')
    m = io.read_metrics(spark, str(tmp_path / "m.json"))
    assert evaluate.ids_from_metrics(m, "patient_classification_breakdown").count() == 2
    assert "| 1 |" in io.markdown_report("x", {"s": days.select("id").orderBy("id")})
    with pytest.raises(exprs.MissingColumns):
        exprs.require_columns(days, ["nothing"])


def test_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, d, h), float(10 * d + h)) for d in (1, 2, 3, 9) for h in (0, 12)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    daily.run_once(daily.daily_exceedance(s, "user_id", "ts", "value", 20.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["day"].day: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3} and got[2]["mean"] == 26.0 and got[2]["n_peaks"] == 1 and math.isclose(got[3]["max"], 42.0)
