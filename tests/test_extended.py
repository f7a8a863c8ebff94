"""Operators without SQL against NumPy, brute force or a round trip."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohorta.functions import exprs
from cohorta.operators import cells, matching, ml, reduce as red, spatial, stats
from cohorta.plans import catalog, extended
from cohorta.sources import io

DATA = "/root/testdata/sf0.001"


def table(spark, columns, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in columns))


def test_ridge_logistic_is_at_its_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=300) > 0.3).astype(float)
    got = {r["variable"]: r for r in stats.ridge_logistic(table(spark, ["a", "b", "y"], np.column_stack([x, y])), ["a", "b"], "y", c=0.5).collect()}
    w, z = np.zeros(3), np.column_stack([x, np.ones(300)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([2.0, 2.0, 0.0])
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    assert [got[c]["coefficient"] for c in "ab"] == pytest.approx(list(w[:2]), abs=1e-4) and got["a"]["odds_ratio"] == pytest.approx(np.exp(w[0]), abs=1e-3)


def test_kmo_rank_and_components_match_numpy(spark):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    d = spark.read.parquet(f"{DATA}/lineitem.parquet")
    x = np.array([[float(v) for v in r] for r in d.select(*columns).collect()])
    r, n = stats.correlation_matrix(d, columns)
    assert n == len(x) and np.allclose(r, np.corrcoef(x.T), atol=1e-9)
    inverse = np.linalg.inv(np.corrcoef(x.T))
    part = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(4, dtype=bool)
    kmo, chi, dof, _ = stats.kmo_bartlett(r, n)
    assert kmo == pytest.approx((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (part[off] ** 2).sum())) and dof == 6
    assert chi == pytest.approx(-(n - 1 - 13 / 6) * np.log(np.linalg.det(np.corrcoef(x.T))))
    assert stats.collinearity_rank(d.withColumn("twice", F.col("l_quantity") * 2), ["l_quantity", "twice", "l_tax"]) == 2
    out, made = red.principal_components(d, columns, 1.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = np.var(np.array([[r[f"PC{k + 1}"] for k in range(made.kept)] for r in out.collect()]), axis=0)
    assert got / got.sum() == pytest.approx(np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1] / 4, abs=1e-3)


def test_nearest_rows_match_brute_force(spark):
    rng = np.random.default_rng(2)
    sites = np.vstack([rng.normal(size=(60, 2)), [[40.0, 40.0], [40.0, 40.0]]])
    points = np.vstack([rng.normal(size=(40, 2)) * 3, [[-90.0, 3.0], [39.0, 41.0]]])
    p = table(spark, ["id", "x", "y"], [(i, *v) for i, v in enumerate(points)]).withColumn("v", F.lit(None).cast("double"))
    s = table(spark, ["sx", "sy", "v"], [(*v, i) for i, v in enumerate(sites)])
    got = {r["id"]: r["v"] for r in spatial.nearest_fill(p, s, "id", "v").collect()}
    for i, v in enumerate(points):
        gap = np.sqrt(((sites - v) ** 2).sum(axis=1))
        assert got[i] == min(range(len(sites)), key=lambda k: (gap[k], *sites[k], k))
    assert [r["v"] for r in spatial.nearest_fill(p.limit(1), s.limit(0), "id", "v").collect()] == [None]


def test_nearest_case_needs_no_product(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.choice((1, 2, 3, 50))), float(rng.random() * 9), rng.choice("ab"), int(i % 5 == 0)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c string, is_case int").withColumn("day", F.lit("2020-01-01").cast("date"))
    out = matching.nearest_case(d, ["a", "b", "c"], "id", "day")
    got = {r["id"]: r["matched_case_id"] for r in out.collect()}
    scale = [np.std([r[k] for r in rows]) for k in (1, 2)]
    for r in rows:
        if not r[4]:
            gap = lambda q: round(sum(((r[k] - q[k]) / scale[k - 1]) ** 2 for k in (1, 2)) + (r[3] != q[3]), 9)
            assert got[r[0]] == min((q for q in rows if q[4]), key=lambda q: (gap(q), q[0]))[0]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def most_rows(df):
    """Rows that the largest step of the collected frame's plan put out."""
    df.collect()
    made, walk = [], [df._jdf.queryExecution().executedPlan()]
    while walk:
        node = walk.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            walk.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            walk.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            made.append(rows.get().value())
        walk += [node.children().apply(i) for i in range(node.children().size())]
    return max(made)


def crowded(seed, n):
    """Places with copies, neighbours at exactly the radius of 3 or 5, a cluster, far and missing ones."""
    rng = np.random.default_rng(seed)
    xy = np.vstack([rng.integers(0, 12, size=(n // 2, 2)).astype(float), rng.normal(size=(n - n // 2 - 1, 2)) * [0.4, 3.0] + 5.0, [[4000.0, -7.0]]])
    return [(i, float(x), float(y), float(np.round(rng.normal(), 2))) for i, (x, y) in enumerate(xy)] + [(n, None, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0)]


def gap(p, q):
    return float("nan") if None in (p[1], q[1]) else np.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)


def weighted(near):
    at = [v for d, *_, v in near if d == 0]
    return max(at) if at else sum(v / d**2 for d, *_, v in near) / sum(1 / d**2 for d, *_ in near)


def test_band_cascade_makes_no_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice((None, 20.0, 21.5, 23.0, 40.0, rng.random() * 60)), rng.choice("ab"), rng.choice(("x", "y", "z", None)), int(i % 4 == 0)) for i in range(240)]
    rows += [(1000 + i, 70.0, "a", "x", int(i >= 300)) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, age double, s string, p string, is_case int").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")))
    out = matching.band_cascade(d.where("is_case = 0"), d.where("is_case = 1"), "id", "age", ["s", "p"], "day")
    got = {r["id"]: r for r in out.collect()}
    cases = [q for q in rows if q[4] and q[1] is not None]
    for r in [r for r in rows if not r[4]]:
        agree = lambda q: [q[k] is not None and r[k] == q[k] for k in (2, 3)]
        score = lambda q: (r[1] - q[1]) * (r[1] - q[1]) + sum(100 for a in agree(q) if not a)
        near = min((q for q in cases if r[1] is not None and abs(r[1] - q[1]) <= 3), key=lambda q: ([not a for a in agree(q)], score(q), q[0]), default=None)
        assert (got[r[0]]["matched_case_id"], got[r[0]]["score"]) == ((near[0], score(near)) if near else (None, None))
    assert most_rows(out) < 20 * len(rows)


@pytest.mark.parametrize("size", [50_000, 70])
def test_cross_validated_interpolation_makes_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "SLICE", size)
    rows = crowded(1, 700)
    s = spark.createDataFrame(rows, "id long, sx double, sy double, v double")
    out = spatial.idw_cross_validation(s, "id", "v", radius=5.0, most=4).collect()
    errors = {f: [] for f in range(5)}
    for p in rows:
        near = sorted((gap(p, q), *q[1:]) for q in rows if q[0] % 5 != p[0] % 5 and gap(p, q) <= 5)[:4]
        if len(near) >= 3:
            errors[p[0] % 5].append(abs(weighted(near) - p[3]))
    assert {r["fold"]: r["n"] for r in out} == {f: len(e) for f, e in errors.items()}
    if size > len(rows):
        dense = s.where("sx < 100").select("id", "v", (F.col("sx") / 100).alias("sx"), (F.col("sy") / 100).alias("sy"))
        assert most_rows(spatial.idw_cross_validation(dense, "id", "v", radius=5.0, most=4)) < 20 * len(rows)
    # Copies of a place in several folds are told apart by fold, not by value, so errors are compared without them.
    once = list({(p[1], p[2]): p for p in rows if p[1] is not None}.values())
    out = spatial.idw_cross_validation(spark.createDataFrame(once, "id long, sx double, sy double, v double"), "id", "v", radius=5.0, most=4).collect()
    errors = {f: [] for f in range(5)}
    for p in once:
        near = sorted((gap(p, q), *q[1:]) for q in once if q[0] % 5 != p[0] % 5 and gap(p, q) <= 5)[:4]
        if len(near) >= 3:
            errors[p[0] % 5].append(abs(weighted(near) - p[3]))
    assert {r["fold"]: r["mae"] for r in out} == {f: pytest.approx(np.mean(e), rel=1e-9, nan_ok=True) for f, e in errors.items()}


@pytest.mark.parametrize("size", [50_000, 70])
def test_interpolation_makes_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "SLICE", size)
    rows = crowded(2, 900)
    targets, stations = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    t = spark.createDataFrame([r[:3] for r in targets], "id long, x double, y double")
    s = spark.createDataFrame([(*r[1:], "d") for r in stations] + [(5.0, 5.0, None, "d"), (5.0, 5.0, 9.0, None)], "sx double, sy double, v double, day string")
    out = spatial.idw(t.withColumn("day", F.lit("d")), s, ["id"], "v", 3.0, most=5, on=["day"])
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(targets)
    for p in targets:
        near = sorted((gap(p, q), *q[1:]) for q in stations if gap(p, q) <= 3)[:5]
        assert got[p[0]]["n_neighbors"] == len(near) and got[p[0]]["estimate"] == (pytest.approx(weighted(near)) if len(near) >= 3 else None)
    if size > len(rows):
        assert most_rows(spatial.idw(t.withColumn("day", F.lit("d")).where("x < 100"), s, ["id"], "v", 300.0, most=5, on=["day"])) < 20 * len(rows)


@pytest.mark.parametrize("size", [50_000, 70])
def test_fill_within_a_radius_makes_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "SLICE", size)
    rows = crowded(3, 900)
    p = spark.createDataFrame([(i, x, y, None if i % 3 else f"{v}") for i, x, y, v in rows], "id long, x double, y double, v string")
    s = p.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    got = {r["id"]: r["v"] for r in spatial.nearest_fill(p, s, "id", "v", 3.0).collect()}
    sites = [q for q in rows if q[0] % 3 == 0]
    for r in rows:
        near = min(((gap(r, q), q[1], q[2], f"{q[3]}") for q in sites if gap(r, q) <= 3), default=(None,))
        assert got[r[0]] == (near[-1] if r[0] % 3 else f"{r[3]}")
    if size > len(rows):
        assert most_rows(spatial.nearest_fill(p.where("x < 100"), s, "id", "v", 300.0)) < 20 * len(rows)


def lags(rows, radius):
    mean = np.mean([r[3] for r in rows])
    near = {p[0]: [q[3] - mean for q in rows if q[0] != p[0] and gap(p, q) <= radius] for p in rows}
    return {p[0]: (p[3] - mean, float(np.mean(near[p[0]])) if near[p[0]] else 0.0, len(near[p[0]])) for p in rows}


@pytest.mark.parametrize("size", [50_000, 70])
def test_global_moran_makes_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(cells, "SLICE", size)
    rows = crowded(4, 900)
    p = spark.createDataFrame(rows, "id long, x double, y double, v double")
    for radius in (3.0, 0.25):
        want, band = lags(rows, radius), spatial.Band(p, "id", "x", "y", radius)
        got = {r["id"]: r for r in spatial.spatial_lag(p, band, "id", "v").collect()}
        assert {k: (r["z"], r["lag"]) for k, r in got.items()} == {k: (pytest.approx(z), pytest.approx(m, abs=1e-9)) for k, (z, m, _) in want.items()}
        one = spatial.moran_global(p, band, "id", "v").first()
        whole = sum(z * m for z, m, _ in want.values()) / sum(z * z for z, _, _ in want.values()) * len(rows) / sum(n > 0 for _, _, n in want.values())
        assert one["moran_i"] == pytest.approx(whole) and one["n"] == len(rows)
    flat = p.withColumn("v", F.lit(2.0))
    assert spatial.moran_global(flat, spatial.Band(flat, "id", "x", "y", 3.0), "id", "v").first()["moran_i"] is None
    twice = p.union(p.where("id = 3"))
    listed = spatial.moran_global(twice, spatial.distance_band(twice, "id", "x", "y", 3.0), "id", "v").first()
    assert spatial.moran_global(twice, spatial.Band(twice, "id", "x", "y", 3.0), "id", "v").first()["moran_i"] == pytest.approx(listed["moran_i"])
    if size > len(rows):
        dense = p.where("x < 100")
        assert most_rows(spatial.moran_global(dense, spatial.Band(dense, "id", "x", "y", 300.0), "id", "v")) < 20 * len(rows)


def test_local_moran_makes_no_pairs(spark, monkeypatch):
    rows = crowded(5, 600)
    p, want = spark.createDataFrame(rows, "id long, x double, y double, v double"), lags(rows, 3.0)
    monkeypatch.setattr(spatial, "distance_band", None)
    m2 = np.mean([z * z for z, _, _ in want.values()])
    got = {r["id"]: r for r in spatial.moran_local(p, spatial.Band(p, "id", "x", "y", 3.0), "id", "v").collect()}
    for k, (z, m, _) in want.items():
        assert got[k]["local_i"] == pytest.approx(z * m / m2, abs=1e-9)
        assert abs(m) < 1e-9 or got[k]["quadrant"] == {(True, True): 1, (False, True): 2, (False, False): 3, (True, False): 4}[z > 0, m > 0]
    assert catalog.QUERIES["moran_local_quadrant"](spark, DATA).count() > 0


def test_slope_makes_no_pairs(spark, monkeypatch):
    rows = crowded(6, 600)
    p, want = spark.createDataFrame(rows, "id long, x double, y double, v double"), lags(rows, 3.0)
    monkeypatch.setattr(spatial, "distance_band", None)
    one = spatial.moran_slope(p, spatial.Band(p, "id", "x", "y", 3.0), "id", "v").first()
    z, m = (np.array([w[k] for w in want.values()]) for k in (0, 1))
    assert one["slope"] == pytest.approx(np.polyfit(z, m, 1)[0]) and one["r"] == pytest.approx(np.corrcoef(z, m)[0, 1])
    assert catalog.QUERIES["moran_slope"](spark, DATA).count() == 1


def test_tested_local_moran(spark):
    p = table(spark, ["id", "x", "y", "t"], [(i, i % 10, i // 10, 10.0 if i % 10 < 5 else -10.0) for i in range(100)])
    w = spatial.distance_band(p, "id", "x", "y", 1.5)
    got = {r["id"]: r for r in spatial.moran_local_tested(p, w, "id", "t", rounds=99).collect()}
    inside = [got[i] for i in range(100) if i % 10 in (1, 2, 7, 8) and 10 <= i < 90]
    assert sum(r["significant"] for r in inside) > 0.6 * len(inside) and {r["quadrant"] for r in inside} == {1, 3}
    best = spatial.strongest_cluster(table(spark, ["cluster", "z"], [(1, -5), (2, 4), (3, 5)]), "cluster", "z").first()
    assert (best["cluster"], best["z"]) == (1.0, -5.0)


def test_tested_local_moran_makes_no_pairs(spark, monkeypatch):
    p = table(spark, ["id", "x", "y", "t"], [(i, i % 10, i // 10, 10.0 if i % 10 < 5 else -10.0) for i in range(100)] + [(100, 900, 0, 0)])
    listed = {r["id"]: r for r in spatial.moran_local_tested(p, spatial.distance_band(p, "id", "x", "y", 1.5), "id", "t", rounds=99).collect()}
    rows = {r["id"]: (r["z"], r["lag"], r["degree"]) for r in spatial._lag(p, spatial.Band(p, "id", "x", "y", 1.5), "id", "t").collect()}
    hashes = {(r["round"], r["id"]): r["h"] for r in p.select("id", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("round")).withColumn("h", F.xxhash64(F.lit(1), "round", "id")).collect()}
    monkeypatch.setattr(spatial, "distance_band", None)
    out = spatial.moran_local_tested(p, spatial.Band(p, "id", "x", "y", 1.5), "id", "t", rounds=99)
    got = {r["id"]: r for r in out.collect()}
    assert {k: r["quadrant"] for k, r in got.items()} == {k: r["quadrant"] for k, r in listed.items()}
    orders = [sorted(rows, key=lambda i: hashes[r, i]) for r in range(1, 100)]
    for i, (z, lag, degree) in rows.items():
        draws = [[q for q in o if q != i][:degree] for o in orders]
        above = sum(z * np.mean([rows[q][0] for q in d]) >= z * lag - 1e-7 for d in draws) if degree else None
        assert got[i]["p"] == (pytest.approx((min(above, 99 - above) + 1) / 100) if degree else None)
    inside = [i for i in range(100) if i % 10 in (1, 2, 7, 8) and 10 <= i < 90]
    assert sum(got[i]["significant"] for i in inside) > 0.6 * len(inside) and not got[100]["significant"]
    q = table(spark, ["id", "x", "y", "t"], [(i, i % 9, i % 7, i % 5) for i in range(300)])
    assert {r["p"] is None for r in spatial.moran_local_tested(q, spatial.Band(q, "id", "x", "y", 100.0), "id", "t", rounds=9).collect()} == {False}


def drawn(lag, rounds):
    """p of each key of (id, z, lag, degree), draw by draw; NULL without neighbours or without a value."""
    rows = lag.collect()
    hashed = lag.select("id").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).select("round", "id", F.xxhash64(F.lit(1), "round", "id"))
    hashes = {(r, i): h for r, i, h in hashed.collect()}
    z = np.array([r["z"] or 0.0 for r in rows])
    slack, above = 1e-9 * np.mean([r["z"] ** 2 for r in rows if r["z"] is not None]), np.zeros(len(rows), int)
    for n in range(1, rounds + 1):
        order = np.lexsort((z, np.array([hashes[n, r["id"]] for r in rows])))
        for i, r in enumerate(rows):
            if r["degree"]:
                others = order[: r["degree"] + 1]
                above[i] += z[i] * z[others[others != i][: r["degree"]]].mean() >= z[i] * r["lag"] - slack
    return {r["id"]: (min(a, rounds - a) + 1) / (rounds + 1) if r["degree"] and r["z"] is not None else None for r, a in zip(rows, above)}


def test_registered_local_moran_is_tested_in_999_rounds(spark):
    p = catalog._points(spark, DATA)
    want = drawn(spatial._lag(p, spatial.Band(p, "id", "x", "y", 40.0), "id", "t"), 999)
    got = {r["id"]: r for r in extended.moran_local_tested(spark, DATA).collect()}
    assert len(got) == p.count() and {k: r["p"] for k, r in got.items()} == pytest.approx(want)
    assert {r["significant"] for r in got.values()} == {True, False} and all(r["significant"] == ((r["p"] or 1) < 0.05) for r in got.values())


@pytest.mark.parametrize("met", [20_000, 40])
def test_rounds_in_bands_and_slices(spark, monkeypatch, met):
    """More neighbours than a band holds, bands in slices, rows without a key or a value."""
    monkeypatch.setattr(spatial, "MET", met)
    rows = [(i, x, y, None if i % 50 == 3 else v) for i, x, y, v in crowded(7, 300)] + [(None, 0.0, 0.0, float(i % 7)) for i in range(2500)]
    p = spark.createDataFrame(rows, "id long, x double, y double, v double")
    band = spatial.Band(p, "id", "x", "y", 5.0)
    lag = spatial._lag(p, band, "id", "v")
    assert lag.agg(F.max("degree")).first()[0] > 2 * spatial.BAND
    want = drawn(lag, 19)
    got = {r["id"]: r for r in spatial.moran_local_tested(p, band, "id", "v", rounds=19, level=0.06).where("id IS NOT NULL").collect()}
    assert {k: r["p"] for k, r in got.items()} == pytest.approx({k: v for k, v in want.items() if k is not None})
    assert any(r["significant"] for r in got.values()) and not any(got[i]["significant"] for i in range(3, 300, 50))


def test_constant_values_have_no_p(spark):
    p = table(spark, ["id", "x", "y", "t"], [(i, i, 0, 2) for i in range(9)])
    for w in (spatial.Band(p, "id", "x", "y", 1.5), spatial.distance_band(p, "id", "x", "y", 1.5)):
        assert {(r["p"], r["significant"]) for r in spatial.moran_local_tested(p, w, "id", "t", rounds=39).collect()} == {(None, False)}


def test_splits_state_and_models_are_kept(spark, tmp_path):
    t = catalog._model_table(spark, DATA)
    train, test = ml.split(t, "c_custkey")
    io.write_splits({"train": train, "test": test}, "c_custkey", str(tmp_path / "s"))
    assert {r[0] for r in io.read_split(t, str(tmp_path / "s"), "test", "c_custkey").select("c_custkey").collect()} == {r[0] for r in test.select("c_custkey").collect()}
    columns = (["n_orders", "avg_price"], ["c_mktsegment"])
    prep, model = ml.fit_strategy(train, "smote_enn", "y", "c_custkey", *columns, trees=5, depth=3)
    ml.save_strategy(prep, model, str(tmp_path / "m"))
    again = [r[0] for r in ml.scores(*ml.load_strategy(str(tmp_path / "m")), test, "y").orderBy("c_custkey").select("score").collect()]
    assert again == [r[0] for r in ml.scores(prep, model, test, "y").orderBy("c_custkey").select("score").collect()]
    state = str(tmp_path / "state")
    assert io.finished(spark, state) == []
    out = ml.resumable(t, state, "y", "c_custkey", *columns, ["none", "smote_enn"], trees=5, depth=3).collect()
    assert sorted(io.finished(spark, state)) == ["none", "smote_enn"] and all(r["error"] == "" and r["roc_auc"] is not None for r in out)


def test_strategies_do_not_fail(spark):
    out = catalog.QUERIES["rf_strategies"](spark, DATA).collect()
    assert {r["strategy"] for r in out} == set(ml.STRATEGIES) and all(r["error"] == "" for r in out)


def test_squared_distances():
    x = np.random.default_rng(3).normal(size=(30, 4))
    want = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(want, -1)
    assert ml._squared(x) == pytest.approx(want)


def test_subsets_and_flags(spark):
    d = spark.createDataFrame([(1, "OUI", None), (2, None, 1.0)], "id long, s string, v double")
    out = ml.by_subset(d, "id", [1, 9], lambda p: p.select(F.count(F.lit(1)).alias("n"))).collect()
    assert [(r["subset"], r["n"], r["error"]) for r in out] == [("1", 1, None), ("9", None, "no rows")]
    assert [r[0] for r in d.orderBy("id").select(exprs.flag_by(F.col("s"), {"oui": 1})).collect()] == [1, None]
    from cohorta.operators.cohort import any_null

    assert [r[0] for r in d.where(any_null(["s", "v"])).orderBy("id").select("id").collect()] == [1, 2]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Away:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.scratch_path(Away, "x")
