"""Queries that fit models. They have no SQL form; tests compare them with numeric twins."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from frostline.catalog.registry import query, rounded
from frostline.catalog.requests import timed
from frostline.catalog.roles import daily_counts, long_hourly
from frostline.catalog.series import calendar, daily_model, features, master, weekly_model
from frostline.models import boosting, clusters, linear, registry as reg, sweep
from frostline.models import metrics as mt
from frostline.operators import encoding, panel as pn, rollups as ro, splits as sp
from frostline.plans import daily as pd_
from frostline.runtime import materialize, scratch_path
from frostline.schema import DEFAULT_PARAMS, FEATURE_PARAMS
from frostline.sources import sinks

FEATURES = pd_.feature_columns()
WARD = "ward"


def split_features(spark, sf):
    """Feature matrix with split, stored because every fitting pass reads it."""
    return materialize(sp.make_split(features(spark, sf), calendar(spark)), "features")


def weekly_split(spark, sf):
    """Weekly model table with split and ward columns, stored; returns (table, feature names)."""
    t = materialize(pn.time_split(weekly_model(spark, sf)), "weekly-model")
    levels = encoding.train_levels(t.where(F.col("split") == "train"), "ward")
    hot = [f"ward_{v}".replace(" ", "_") for v in levels]
    return encoding.one_hot(t, "ward", levels), pn.panel_feature_columns() + hot


def scores(df, target, label):
    return mt.metrics(df.withColumn("model", F.lit(label)), ["model", "split"], target)


@query("m4_vif")
def m4(spark, sf):
    d = materialize(daily_model(spark, sf), "daily-model")
    v = linear.vif(d, pd_.VIF_COLUMNS, WARD).withColumnRenamed("g", "ward")
    return rounded(v.orderBy("ward", F.desc("vif")), 4)


@query("m9_ridge")
def m9(spark, sf):
    t = split_features(spark, sf)
    fitted = reg.fit("ridge", t.where(F.col("split") == "train"), FEATURES, "Y", WARD)
    return rounded(fitted.predict(t).select("ward", "date", "split", "Y", "y_pred"), 4)


@query("m10_poisson_glm")
def m10(spark, sf):
    t, names = weekly_split(spark, sf)
    x = VectorAssembler(inputCols=names, outputCol="x").transform(t.withColumn("y", F.col("y").cast("double")))
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y",
                                      predictionCol="y_pred", maxIter=200, tol=1e-8)
    model = glm.fit(x.where(F.col("split") == "train"))
    out = []
    for s in ("valid", "test"):
        p = model.transform(x.where(F.col("split") == s)).select("ward", "week", "y", "split", "y_pred")
        out.append(mt.safe_clip(p, "y_pred"))
    return rounded(mt.aligned(out[0].unionByName(out[1]), "y", "y_pred", "poisson").drop("y"), 4)


@query("m11_negbin_glm")
def m11(spark, sf):
    t, names = weekly_split(spark, sf)
    train, rest = t.where(F.col("split") == "train"), t.where(F.col("split") != "train")
    out = None
    for name in ("negbin_fixed", "negbin"):
        p = reg.fit(name, train, names, "y", F.lit("all")).predict(rest)
        s = scores(p, "y", name)
        out = s if out is None else out.unionByName(s)
    return rounded(out, 4)


# The library's rounds and rate; depth and shares as in the weekly model of the origin. Every round is a handful of Spark jobs.
BOOST = {"depth": 5, "row_share": 0.8, "column_share": 0.8, "key": ["ward", "week"]}
DAILY = {"boosted": {**BOOST, "key": ["ward", "date"]}}


@query("m12_poisson_gbt")
def m12(spark, sf):
    t, names = weekly_split(spark, sf)
    fitted = reg.fit("boosted", t.where(F.col("split") == "train"), names, "y", F.lit("all"), **BOOST)
    return rounded(scores(fitted.predict(t), "y", "boosted"), 4)


@query("m13_importances")
def m13(spark, sf):
    t, names = weekly_split(spark, sf)
    model = boosting.fit_boosted_counts(t.where(F.col("split") == "train"), names, "y", **BOOST)
    return rounded(boosting.importance_table(spark, model).orderBy(F.desc("importance"), "feature"), 6)


@query("m15_kfold_cv")
def m15(spark, sf):
    t = split_features(spark, sf).where(F.col("split") == "train")
    folds = sp.fold_days(t, 5).select("date", "fold")
    t = materialize(t.join(folds, "date"), "cv")
    out = None
    for name in reg.MODELS:
        m = reg.mean_cv(reg.cross_val(t, FEATURES, "Y", name, **DAILY.get(name, {}))).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return rounded(out, 4)


@query("m16_train_eval")
def m16(spark, sf):
    """Fit on train + val, store the model, read it back and score val and test rows."""
    t = split_features(spark, sf)
    path = scratch_path(spark, "models")
    for name in reg.MODELS:
        fitted = reg.fit(name, t.where(F.col("split") != "test"), FEATURES, "Y", WARD, **DAILY.get(name, {}))
        reg.save(spark, fitted, f"{path}/{name}", DEFAULT_PARAMS)
        stored, _ = reg.load(spark, f"{path}/{name}", WARD)
        scored = stored.predict(t.where(F.col("split") != "train"))
        sinks.append_metrics(mt.metrics(scored, ["ward", "split"], "Y"), f"{path}/metrics", name, "evaluate")
    return rounded(spark.read.parquet(f"{path}/metrics").drop("saved_at", "stage"), 4)


@query("m17_rolling_cv")
def m17(spark, sf):
    t, names = weekly_split(spark, sf)
    t = t.drop("split")
    folds = pn.expanding_folds(t)
    return rounded(reg.rolling_cv(t, names, "y", folds, {"poisson": {}, "negbin_fixed": {"alpha": 1.0}, "boosted": BOOST}), 4)


@query("m19_kmeans")
def m19(spark, sf):
    f = materialize(ro.type_features(timed(spark, sf, "service", "ward"), min_support=50), "type-features")
    return rounded(clusters.cluster_types(f).select("service", "n_requests", "cluster_kmeans"))


def sweep_input(spark, sf):
    return materialize(sp.make_split(master(spark, sf), calendar(spark)), "master")


@query("p1_grid_sweep")
def p1(spark, sf):
    return rounded(sweep.run_grid(sweep_input(spark, sf)), 4)


@query("p6_top_grid")
def p6(spark, sf):
    path = scratch_path(spark, "grid")
    sinks.save_ranked(sweep.run_grid(sweep_input(spark, sf)), path, F.col("ward"), *sweep.ranking())
    return rounded(sweep.top_per_area(spark.read.parquet(path), 10), 4)


@query("p8_random_search")
def p8(spark, sf):
    m = sweep_input(spark, sf)
    warm = materialize(sweep.top_per_area(sweep.run_grid(m), 20).select("ward", *FEATURE_PARAMS), "warm")
    return rounded(sweep.top_per_area(sweep.run_search(m, 200, warm), 20), 4)
