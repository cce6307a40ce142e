"""Models by name with one interface, cross-validation and the train / evaluate protocol.

Linear models are fitted for all groups (areas, folds) in the same passes; the tree model
pools the areas, and the trees of all folds grow in the same jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.models import linear
from frostline.models.boosting import BoostedCounts, fit_boosted_counts, fit_many, load_boosted, predict_each, save_boosted
from frostline.models.metrics import mae, metrics, poisson_deviance, rmse
from frostline.runtime import materialize


@dataclass
class Fitted:
    """``predict`` appends y_pred (never negative). Linear models carry their terms, a table (g, terms): per
    group the intercept followed by the coefficients of ``features``; trees carry the boosted model."""
    name: str
    predict: Callable[[DataFrame], DataFrame]
    features: list[str]
    link: str = "identity"
    terms: DataFrame | None = None
    trees: BoostedCounts | None = None


def _linear(name, features, terms: DataFrame, group: str | Column, link="identity") -> Fitted:
    """The terms are solved once and stored: predictions and copies read them."""
    terms = materialize(terms.select("g", "terms"), "terms")
    return Fitted(name, lambda df: linear.linear_score(features, terms, df, group, link), list(features), link, terms)


def save(spark, fitted: Fitted, path: str, params: dict | None = None) -> None:
    """Store a fitted model with its feature names and parameters; one row per group."""
    if fitted.trees is not None:
        save_boosted(spark, fitted.trees, f"{path}/trees")
    terms = fitted.terms if fitted.terms is not None else spark.createDataFrame([("all", [])], linear.TERMS)
    terms.select(
        F.lit(fitted.name).alias("name"), F.lit(fitted.link).alias("link"),
        F.array(*[F.lit(f) for f in fitted.features]).cast("array<string>").alias("features"),
        F.lit(json.dumps(params or {}, sort_keys=True)).alias("params"), "g", "terms",
    ).write.mode("overwrite").parquet(f"{path}/model")


def load(spark, path: str, group: str | Column) -> tuple[Fitted, dict]:
    """The model stored at ``path`` and its parameters."""
    stored = spark.read.parquet(f"{path}/model")
    first = stored.first()
    if first["name"] in POOLED:
        trees = load_boosted(spark, f"{path}/trees")
        fitted = Fitted(first["name"], trees.predict, trees.features, trees=trees)
    else:
        fitted = _linear(first["name"], first["features"], stored, group, first["link"])
    return fitted, json.loads(first["params"])


def fit_mean(df, features, target, group, **_) -> Fitted:
    return _linear("mean", [], linear.means(df, target, group), group)


def fit_ridge(df, features, target, group, alpha: float = 1.0, **_) -> Fitted:
    return _linear("ridge", features, linear.ridge(df, features, target, group, alpha), group)


def fit_poisson(df, features, target, group, **_) -> Fitted:
    return _linear("poisson", features, linear.fit_log_linear(df, features, target, group), group, "log")


def fit_negbin_fixed(df, features, target, group, alpha: float = 1.0, **_) -> Fitted:
    return _linear("negbin_fixed", features, linear.fit_log_linear(df, features, target, group, alpha), group, "log")


def fit_negbin(df, features, target, group, **_) -> Fitted:
    """Estimated dispersion; a group whose fit is not finite falls back to Poisson."""
    found = linear.fit_negbin(df, features, target, group)
    broken = F.exists("terms", lambda b: F.isnan(b) | (F.abs(b) == float("inf")))
    if not found.where(broken).isEmpty():
        plain = linear.fit_log_linear(df, features, target, group).select("g", F.col("terms").alias("plain"))
        found = found.join(plain, "g").select("g", F.when(broken, F.col("plain")).otherwise(F.col("terms")).alias("terms"))
    return _linear("negbin", features, found, group, "log")


def fit_boosted(df, features, target, group, **options) -> Fitted:
    model = fit_boosted_counts(df, features, target, **options)
    return Fitted("boosted", model.predict, list(features), trees=model)


MODELS = {"mean": fit_mean, "ridge": fit_ridge, "poisson": fit_poisson, "negbin_fixed": fit_negbin_fixed,
          "negbin": fit_negbin, "boosted": fit_boosted}
POOLED = {"boosted"}
FIXED_ALPHA = {"poisson", "negbin_fixed"}  # one fit for any number of these


def fit(name: str, df: DataFrame, features: list[str], target: str, group: Column, **options) -> Fitted:
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](df, features, target, group, **options)


def cross_val(df: DataFrame, features: list[str], target: str, model: str, k: int = 5, fold: str = "fold",
              area: str = "ward", **options) -> DataFrame:
    """Per (area, fold) metrics of a k-fold cross-validation.

    A grouped model sends every row once to each fold it trains, under the group key area|fold, and needs
    one fit for all folds; a pooled one keeps a row once, with the folds it trains.
    """
    if model in POOLED:
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold))
        scored = predict_each(fit_many(df, features, target, others, k, **options), df, F.col(fold))
    else:
        train = df.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("_f") != F.col(fold))
        fitted = fit(model, train.withColumn("_key", F.concat_ws("|", area, "_f")), features, target, F.col("_key"), **options)
        scored = fitted.predict(df.withColumn("_key", F.concat_ws("|", area, fold)))
    return metrics(scored, [area, fold], target)


def mean_cv(fold_metrics: DataFrame, area: str = "ward") -> DataFrame:
    """Mean of the fold metrics per area."""
    return fold_metrics.groupBy(area).agg(
        F.avg("mae").alias("cv_mae"), F.avg("rmse").alias("cv_rmse"),
        F.avg("poisson_deviance").alias("cv_poisson_deviance"), F.count("*").alias("folds"))


def train_evaluate(df: DataFrame, features: list[str], target: str, model: str, area: str = "ward", **options
                   ) -> tuple[Fitted, DataFrame]:
    """Fit on train + val; metrics on val (seen in the fit) and on the untouched test rows."""
    fitted = fit(model, df.where(F.col("split") != "test"), features, target, F.col(area), **options)
    scored = fitted.predict(df.where(F.col("split") != "train"))
    y, p = F.col(target).cast("double"), F.col("y_pred")
    return fitted, scored.groupBy(area, "split").agg(
        F.count("*").alias("n"), mae(y, p).alias("mae"), rmse(y, p).alias("rmse"),
        poisson_deviance(y, p).alias("poisson_deviance"))


def rolling_cv(df: DataFrame, features: list[str], target: str, folds: DataFrame, models: dict[str, dict],
               week: str = "week") -> DataFrame:
    """Expanding-window metrics per (model, fold); a fold that fails leaves its error text.

    ``models`` maps a registered name to its options. Every model fits all folds in the same passes. Fitting and
    scoring both count: metrics that are not finite are an error, in that fold alone.
    """
    base = materialize(df, "rolling")
    rows = base.join(folds, week)  # one copy of the rows; a pass joins the folds they serve
    train, valid = rows.where(F.col("role") == "train"), rows.where(F.col("role") == "valid")
    spans = rows.groupBy("fold").agg(
        *[f(F.when(F.col("role") == r, F.col(week))).alias(f"{r}_{n}")
          for r in ("train", "valid") for n, f in (("start", F.min), ("end", F.max))],
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "valid").alias("valid_rows"))
    ids = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # bounded by the calendar
    alphas = {name: 0.0 if name == "poisson" else options.get("alpha", 1.0) for name, options in models.items() if name in FIXED_ALPHA}
    together: list[Fitted] = []

    def scored(name: str, options: dict) -> DataFrame:
        if name in alphas:
            if not together:
                found = linear.fit_log_linear_many(train, features, target, F.col("fold"), alphas)
                together.append(_linear("log_linear", features, found, F.col("_key"), "log"))
            return together[0].predict(valid.withColumn("_key", F.concat_ws("|", F.lit(name), F.col("fold").cast("string"))))
        if name not in POOLED:
            return fit(name, train, features, target, F.col("fold"), **options).predict(valid)
        number = (F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("fold")) - 1).cast("int")
        by_week = folds.where(F.col("role") == "train").groupBy(week).agg(F.collect_list(number).alias("_trains"))
        found = fit_many(base.join(by_week, week), features, target, F.col("_trains"), len(ids), **options)
        return predict_each(found, valid, number)

    def checked(fold: int, mae_: float | None, rmse_: float | None) -> tuple:
        if mae_ is None or rmse_ is None or not np.isfinite([mae_, rmse_]).all():
            return fold, mae_, rmse_, "no finite predictions or targets in this fold"
        return fold, mae_, rmse_, ""

    out = None
    for name, options in models.items():
        try:
            found = {r["fold"]: (r["mae"], r["rmse"]) for r in metrics(scored(name, options), ["fold"], target).collect()} if ids else {}
            done = [checked(f, *found.get(f, (None, None))) for f in ids]
        except Exception as exc:  # recorded, so the other models still get their scores
            done = [(f, None, None, str(exc)) for f in ids]
        m = df.sparkSession.createDataFrame(done, "fold int, mae double, rmse double, error string").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.join(spans, "fold")
