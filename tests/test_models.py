"""Fitted models against numpy twins."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frostline.models import boosting, clusters, linear, registry as reg, sweep
from frostline.operators import panel as pn, splits as sp
from frostline.plans import daily as pd_
from frostline.runtime import scratch_path
from frostline.schema import FEATURE_PARAMS


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for ward in ("a", "b"):
        for i in range(150):
            x1, x2 = rng.normal(), rng.normal(2, 3)
            rows.append((ward, i, float(x1), float(x2), float(rng.poisson(np.exp(0.4 + 0.5 * x1 - 0.1 * x2 + (ward == "b"))))))
    pdf = pd.DataFrame(rows, columns=["ward", "i", "x1", "x2", "y"])
    return pdf, spark.createDataFrame(pdf).repartition(5)


def design(p):
    return np.column_stack([np.ones(len(p)), p.x1, p.x2])


def test_ridge(data):
    pdf, df = data
    table = linear.ridge(df, ["x1", "x2"], "y", "ward", alpha=1.0)
    got = linear.as_dict(table)
    for g, p in pdf.groupby("ward"):
        x, y = p[["x1", "x2"]].to_numpy(), p.y.to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        b = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        assert list(got[g][1:]) == pytest.approx(b)
        assert got[g][0] == pytest.approx(y.mean() - x.mean(0) @ b)
    scored = linear.linear_score(["x1", "x2"], table, df, "ward").toPandas()
    assert (scored.y_pred >= 0).all() and len(scored) == 300


def test_unknown_groups_and_missing_features_get_no_prediction(spark):
    terms = spark.createDataFrame([("a", [1.0, 2.0])], linear.TERMS)
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("c", 3.0), (None, 1.0), ("a", -9.0)], "ward string, x double")
    got = [(r["ward"], r["x"], r["y_pred"]) for r in linear.linear_score(["x"], terms, df, "ward").collect()]
    assert sorted(got, key=str) == sorted([("a", 3.0, 7.0), ("a", None, None), ("c", 3.0, None), (None, 1.0, None), ("a", -9.0, 0.0)], key=str)
    far = linear.linear_score(["x"], spark.createDataFrame([("a", [0.0, 40.0])], linear.TERMS), df.limit(1), "ward", "log").first()["y_pred"]
    assert far == pytest.approx(np.exp(120.0))  # not cut


def test_many_groups_stay_off_the_driver(spark):
    df = spark.range(0, 200_000).selectExpr("CAST(id % 50000 AS STRING) AS g", "CAST(id AS DOUBLE) / 1000 AS x", "CAST(2 * id AS DOUBLE) / 1000 + 1 AS y")
    table = linear.ridge(df, ["x"], "y", "g", alpha=0.0)
    assert table.count() == 50_000
    assert table.where(F.abs(F.col("terms")[1] - 2) > 1e-5).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_log_linear_solves_the_score_equations(data, alpha):
    pdf, df = data
    beta = linear.as_dict(linear.fit_log_linear(df, ["x1", "x2"], "y", "ward", alpha))
    for g, p in pdf.groupby("ward"):
        x, mu = design(p), np.exp(design(p) @ beta[g])
        assert x.T @ ((p.y - mu) / (1 + alpha * mu)) == pytest.approx(np.zeros(3), abs=1e-4)


def test_rank_deficient_design_predicts_the_same(data):
    pdf, df = data
    d = df.withColumns({"ha": (F.col("ward") == "a").cast("int"), "hb": (F.col("ward") == "b").cast("int")})
    full = reg.fit("poisson", d, ["x1", "x2", "ha", "hb"], "y", F.lit("all")).predict(d)
    drop = reg.fit("poisson", d, ["x1", "x2", "hb"], "y", F.lit("all")).predict(d)
    a, b = (x.orderBy("ward", "i").toPandas().y_pred for x in (full, drop))
    assert a.to_numpy() == pytest.approx(b.to_numpy(), rel=1e-5)


def test_spark_glm_agrees(data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    _, df = data
    x = VectorAssembler(inputCols=["x1", "x2"], outputCol="f").transform(df)
    m = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="f", labelCol="y").fit(x)
    b = linear.as_dict(linear.fit_log_linear(df, ["x1", "x2"], "y", F.lit("all")))["all"]
    assert [m.intercept, *m.coefficients] == pytest.approx(list(b), rel=1e-5)


def test_dispersion_estimate(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    mu = np.exp(1 + 0.3 * x)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, size=3000))  # variance mu + 0.5 mu^2
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(float)}))
    found = linear.fit_negbin(df, ["x"], "y", F.lit("all")).first()
    assert found["alpha"] == pytest.approx(0.5, abs=0.1)
    assert found["terms"] == pytest.approx([1, 0.3], abs=0.1)


def test_vif(data):
    pdf, df = data
    table = lambda names: {r["feature"]: r["vif"] for r in linear.vif(df.withColumn("x3", F.col("x1") + F.col("x2") * 2), names, F.lit("all")).collect()}
    got = table(["x1", "x2"])
    x = pdf[["x1", "x2"]].to_numpy()
    g = x.T @ x
    assert [got["x1"], got["x2"]] == pytest.approx(np.diag(g) * np.diag(np.linalg.inv(g)))
    dup = table(["x1", "x2", "x3"])
    assert all(np.isinf(v) for v in dup.values())


def test_cross_validation_equals_separate_fits(data):
    pdf, df = data
    d = df.withColumn("fold", F.col("i") % 5)
    got = {(r["ward"], r["fold"]): r["mae"] for r in reg.cross_val(d, ["x1", "x2"], "y", "ridge").collect()}
    for (g, f), value in got.items():
        p = pdf[pdf.ward == g]
        tr, va = p[p.i % 5 != f], p[p.i % 5 == f]
        x, y = tr[["x1", "x2"]].to_numpy(), tr.y.to_numpy()
        b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
        pred = np.clip(y.mean() + (va[["x1", "x2"]].to_numpy() - x.mean(0)) @ b, 0, None)
        assert value == pytest.approx(np.abs(va.y - pred).mean())
    assert len(got) == 10 and reg.mean_cv(reg.cross_val(d, ["x1", "x2"], "y", "mean")).count() == 2


def test_boosting_lowers_the_deviance(data):
    _, df = data
    base = reg.fit("mean", df, [], "y", F.lit("all")).predict(df)
    model = boosting.fit_boosted_counts(df, ["x1", "x2"], "y", rounds=6, rate=0.3, depth=3, row_share=0.8, key=["ward", "i"])
    dev = [reg.metrics(x.withColumn("m", F.lit(1)), ["m"], "y").first()["poisson_deviance"] for x in (base, model.predict(df))]
    assert dev[1] < 0.8 * dev[0]
    assert sum(model.importances().values()) == pytest.approx(1.0)


def test_one_boosting_leaf_is_the_newton_step(data):
    pdf, df = data
    m = boosting.fit_boosted_counts(df.withColumn("c", F.lit(1.0)), ["c"], "y", rounds=1, rate=1.0)
    p = m.predict(df.withColumn("c", F.lit(1.0))).first()["y_pred"]
    assert p == pytest.approx(pdf.y.mean())  # the start is already optimal, so the step is 0


def boosted_twin(x, y, rounds, rate, depth, l2=1.0, bins=64):
    """Means of trees grown node by node on binned columns, without Spark."""
    cuts = [np.unique([np.sort(c)[max(0, int(np.ceil(len(c) * k / bins)) - 1)] for k in range(1, bins)]) for c in x.T]
    b = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
    score = np.full(len(y), np.log(y.mean()))

    def grow(rows, level, g, h):
        best = (1e-9, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
        for j in range(x.shape[1]) if level < depth else ():
            for s in range(len(cuts[j])):
                left = rows[b[rows, j] <= s]
                right = rows[b[rows, j] > s]
                if h[left].sum() < 1 or h[right].sum() < 1:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1] is None:
            return [(rows, -g[rows].sum() / (h[rows].sum() + l2))]
        return [leaf for part in best[1] for leaf in grow(part, level + 1, g, h)]

    for _ in range(rounds):
        mu = np.exp(score)
        for rows, value in grow(np.arange(len(y)), 0, mu - y, mu):
            score[rows] += rate * value
    return np.exp(score)


@pytest.mark.parametrize("rows", [100_000, 60])
def test_boosted_trees_equal_the_twin(data, monkeypatch, rows):
    """In one block and in several, whose histograms are added up."""
    pdf, df = data
    monkeypatch.setattr(boosting, "ROWS", rows)
    monkeypatch.setattr(boosting, "STORE_EVERY", 3)
    model = boosting.fit_boosted_counts(df, ["x1", "x2"], "y", rounds=8, rate=0.3, depth=3)
    got = model.predict(df).orderBy("ward", "i").toPandas()
    p = pdf.sort_values(["ward", "i"])
    assert got.y_pred.to_numpy() == pytest.approx(boosted_twin(p[["x1", "x2"]].to_numpy(), p.y.to_numpy(float), 8, 0.3, 3), rel=1e-9)


def test_models_grown_together_equal_those_grown_alone(data):
    _, df = data
    folds = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: k != F.col("i") % 3)
    options = {"rounds": 4, "rate": 0.3, "depth": 3, "row_share": 0.7, "column_share": 0.5, "key": ["ward", "i"]}
    together = boosting.fit_many(df, ["x1", "x2"], "y", folds, 3, **options)
    for k, model in enumerate(together):
        rows = df.where(F.col("i") % 3 != k)
        own = dict(zip(("a", "b"), (model, boosting.fit_many(df, ["x1", "x2"], "y", F.when(F.col("i") % 3 != k, F.array(F.lit(0))).otherwise(F.array()), 1, **options)[0])))
        a, b = (m.predict(rows).orderBy("ward", "i").toPandas().y_pred.to_numpy() for m in own.values())
        assert a == pytest.approx(b)
    scored = boosting.predict_each(together, df, F.col("i") % 3).orderBy("ward", "i").toPandas()
    alone = together[1].predict(df.where("i % 3 = 1")).orderBy("ward", "i").toPandas()
    assert scored[scored.i % 3 == 1].y_pred.to_numpy() == pytest.approx(alone.y_pred.to_numpy())


def test_boosting_takes_missing_values_and_empty_models(spark):
    rows = [(float("nan") if i % 4 == 0 else float(i), None if i % 9 == 0 else float(i % 3 + (i % 4 == 0) * 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "x double, y double")
    none, some = boosting.fit_many(df, ["x"], "y", F.array(F.lit(1)), 2, rounds=20, rate=0.3, depth=2)
    got = some.predict(df).toPandas()
    assert got[got.x.isna()].y_pred.mean() > 4 > got[~got.x.isna()].y_pred.mean()
    assert none.predict(df).toPandas().y_pred.max() == pytest.approx(0, abs=1e-6)


def test_rolling_cv_records_errors(spark):
    rows = [(w, dt.date(2024, 1, 1) + dt.timedelta(weeks=i), float((i * 7 + len(w)) % 5), float(i)) for w in ("a", "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "ward string, week date, y double, x double")
    r = reg.rolling_cv(df, ["x"], "y", pn.expanding_folds(df), {"poisson": {}, "nope": {}}).collect()
    assert {(x["model"], x["fold"]) for x in r} == set(itertools.product(("poisson", "nope"), (1, 2, 3)))
    assert all(x["mae"] is None and "nope" in x["error"] for x in r if x["model"] == "nope")
    assert all(x["mae"] is not None and x["train_rows"] == 2 * (20 + 4 * x["fold"]) for x in r if x["model"] == "poisson")


def _master(spark, days=200):
    rng = np.random.default_rng(2)
    start = dt.date(2023, 1, 1)
    rows = []
    for w in ("Ward 1", "Ward 2"):
        for i in range(days):
            rain = None if i in (50, 51) else float(rng.gamma(1, 3))
            rows.append((w, start + dt.timedelta(days=i), int(rng.poisson(3)), rain, float(rng.gamma(0.2, 2)), int(rng.random() < 0.1)))
    df = spark.createDataFrame(rows, "ward string, date date, pothole_count int, daily_precip double, daily_snow double, daily_ftc int")
    from frostline.functions.dates import with_calendar_features

    return with_calendar_features(df)


def test_sweep_equals_brute_force(spark):
    master = sp.make_split(_master(spark), None)
    grid = {"d": [1, 7], "d_p": [7, 14], "l_p": [0, 5], "d_s": [7], "l_s": [0], "d_f": [7], "l_f": [0, 10], "k_AR": [5, 10]}
    got = {(r["ward"], *[r[p] for p in FEATURE_PARAMS]): r for r in sweep.run_grid(master, grid).collect()}
    assert len(got) == 2 * 32
    split = master.select("ward", "date", "split")
    for combo in list(itertools.product(*grid.values()))[::5]:
        params = dict(zip(grid, combo))
        f = pd_.assemble_features(master.drop("split"), params).join(split, ["ward", "date"]).toPandas()
        names = pd_.feature_columns(params["k_AR"])
        for w, p in f.groupby("ward"):
            tr, va = p[p.split == "train"], p[p.split == "val"]
            x, y = tr[names].to_numpy(float), tr.Y.to_numpy(float)
            xc = x - x.mean(0)
            b = np.linalg.solve(xc.T @ xc + np.eye(len(names)), xc.T @ (y - y.mean()))
            pred = np.clip(y.mean() + (va[names].to_numpy(float) - x.mean(0)) @ b, 0, None)
            r = got[(w, *combo)]
            assert r["val_mae"] == pytest.approx(np.abs(va.Y - pred).mean(), rel=1e-6)
            yv, mu = va.Y.to_numpy(float), np.clip(pred, 1e-8, None)
            dev = 2 * np.mean(np.where(yv > 0, yv * np.log(np.where(yv > 0, yv, 1) / mu), 0) - (yv - mu))
            assert r["val_poisson_dev"] == pytest.approx(dev, rel=1e-6)


def test_too_few_rows_score_infinity(spark):
    master = sp.make_split(_master(spark, days=40), None)
    grid = {"d": [10], "d_p": [30], "l_p": [20], "d_s": [7], "l_s": [0], "d_f": [7], "l_f": [0], "k_AR": [5]}
    assert all(np.isinf(r["val_mae"]) for r in sweep.run_grid(master, grid).collect())


def test_search_keeps_warm_start_and_ranges(spark):
    master = sp.make_split(_master(spark), None)
    warm = spark.createDataFrame([("Ward 1", 7, 14, 5, 14, 0, 14, 7, 10)], ["ward", *FEATURE_PARAMS]).select(
        "ward", *[F.col(p).cast("int") for p in FEATURE_PARAMS])
    r = sweep.run_search(master, trials=15, warm=warm).toPandas()
    assert ((r.ward == "Ward 1") & (r.d_p == 14) & (r.l_p == 5) & (r.k_AR == 10)).any()
    assert r.d.between(1, 10).all() and r.k_AR.between(5, 20).all() and len(r) >= 30
    top = sweep.top_per_area(spark.createDataFrame(r), 3).toPandas()
    assert sorted(top[top.ward == "Ward 2"].val_mae) == sorted(r[r.ward == "Ward 2"].val_mae)[:3]


def test_clusters(spark):
    rows = [(f"t{i}", float(i % 2) * 100 + i * 0.1, None if i == 3 else 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "service string, a double, b double")
    c = clusters.cluster_types(df, k=2, columns=["a", "b"]).toPandas()
    assert set(c.columns) == {"service", "a", "b", "cluster_kmeans"} and c.cluster_kmeans.nunique() == 2


@pytest.mark.parametrize("name, options", [
    ("mean", {}), ("ridge", {}), ("poisson", {}), ("boosted", {"rounds": 2, "depth": 2, "column_share": 0.5, "key": ["ward", "i"]})])
def test_stored_model_predicts_the_same(spark, data, name, options):
    _, df = data
    fitted = reg.fit(name, df, ["x1", "x2"], "y", "ward", **options)
    path = scratch_path(spark, "model")
    reg.save(spark, fitted, path, {"d": 7})
    back, params = reg.load(spark, path, "ward")
    assert params == {"d": 7} and back.name == name
    a, b = (f.predict(df).orderBy("ward", "i").toPandas().y_pred for f in (fitted, back))
    assert a.to_numpy() == pytest.approx(b.to_numpy())


def test_train_evaluate_leaves_test_rows_out(data):
    pdf, df = data
    d = df.withColumn("split", F.when(F.col("i") < 100, "train").when(F.col("i") < 120, "val").otherwise("test"))
    _, m = reg.train_evaluate(d, [], "y", "mean")
    got = {(r["ward"], r["split"]): (r["n"], r["mae"]) for r in m.collect()}
    for g, p in pdf.groupby("ward"):
        mean = p.y[p.i < 120].mean()
        assert got[(g, "test")] == (30, pytest.approx(np.abs(p.y[p.i >= 120] - mean).mean()))
        assert got[(g, "val")][0] == 20


def test_numeric_matrix(spark):
    from frostline.functions.clean import numeric_matrix

    df = spark.createDataFrame([(True, float("inf"), None), (False, float("nan"), 2.0)], "a boolean, b double, c double")
    assert [tuple(r) for r in numeric_matrix(df, ["a", "b", "c"]).collect()] == [(1.0, 0.0, 0.0), (0.0, 0.0, 2.0)]


def test_registered_searches_take_the_full_grid(spark, data, monkeypatch):
    from frostline.catalog import models as queries

    class Done(Exception):
        pass

    seen = []

    def record(*args, **options):
        seen.append((len(args), options))
        raise Done

    monkeypatch.setattr(queries, "sweep_input", lambda *_: data[1])
    monkeypatch.setattr(sweep, "run_grid", record)
    for f in (queries.p6, queries.p8):
        with pytest.raises(Done):
            f(spark, None)
    assert seen == [(1, {}), (1, {})]  # no grid but the full one


@pytest.mark.parametrize("name", ["m12_poisson_gbt", "m13_importances", "m15_kfold_cv", "m16_train_eval", "m17_rolling_cv"])
def test_registered_model_queries_run_whole(spark, monkeypatch, sf_dir, name):
    """Every model, area and fold on the given tables; only the rounds are fewer here, to save time."""
    from frostline.catalog import models as queries
    from frostline.catalog.registry import QUERIES

    fit_many = boosting.fit_many
    rounds = []

    def fewer(*args, **options):
        rounds.append(options.pop("rounds", 300))
        return fit_many(*args, rounds=6, **options)

    monkeypatch.setattr(boosting, "fit_many", fewer)
    monkeypatch.setattr(reg, "fit_many", fewer)
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert set(rounds) == {300}
    if name in ("m15_kfold_cv", "m16_train_eval"):
        assert set(got.model) == set(reg.MODELS) and got.groupby("model").size().nunique() == 1
        assert np.isfinite(got[got.model != "poisson"].select_dtypes("number")).to_numpy().all()
    if name == "m17_rolling_cv":
        assert set(got.model) == {"poisson", "negbin_fixed", "boosted"} and got.fold.nunique() == got.groupby("model").size().max()
        assert (got[got.model == "boosted"].error == "").all()
    if name == "m13_importances":
        assert got.importance.sum() == pytest.approx(1, abs=1e-4) and len(got) == len(queries.weekly_split(spark, sf_dir)[1])
