"""Prediction tables and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.clean import count_prediction
from frostline.operators.quantiles import aggregate
from frostline.operators.topn import top_k
from frostline.runtime import scalars


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def poisson_deviance(y: Column, p: Column) -> Column:
    """2 * mean(y log(y/p) - (y - p)) with p at least 1e-8; the log term is 0 for y = 0.

    Rows without a prediction do not count."""
    m = F.when(p.isNotNull(), F.greatest(p, F.lit(1e-8)))
    return 2 * F.avg(F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - (y - m))


def metrics(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Errors per group; ``n`` counts the rows that have both values."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    return df.groupBy(*keys).agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), mae(a, b).alias("mae"), rmse(a, b).alias("rmse"),
        poisson_deviance(a, b).alias("poisson_deviance"))


def aligned(df: DataFrame, y: str, p: str, model: str | Column, split: str | Column | None = None) -> DataFrame:
    """Prediction table: clipped finite prediction, error columns, model and split label."""
    yt, yp = F.col(y).cast("double"), count_prediction(F.col(p))
    out = df.withColumns({"y_true": yt, "y_pred": yp}).withColumns({
        "err": F.col("y_pred") - F.col("y_true"),
        "abs_err": F.abs(F.col("y_pred") - F.col("y_true")),
        "ape": F.abs(F.col("y_pred") - F.col("y_true")) / (F.abs("y_true") + 1e-8),
        "model": F.lit(model) if isinstance(model, str) else model,
    })
    if split is not None:
        out = out.withColumn("split", F.lit(split) if isinstance(split, str) else split)
    return out


def worst_errors(predictions: DataFrame, k: int, *ties: str) -> DataFrame:
    return top_k(predictions, k, F.desc("abs_err"), *[F.col(t) for t in ties])


def compare_models(predictions: DataFrame, models: list[str], splits: list[str]) -> DataFrame:
    """MAE and RMSE per (model, split) with the position in the given orders."""
    m = metrics(predictions, ["model", "split"]).select("model", "split", "n", "mae", "rmse")
    return m.withColumns({
        "model_order": F.array_position(F.array(*[F.lit(x) for x in models]), F.col("model")).cast("int"),
        "split_order": F.array_position(F.array(*[F.lit(x) for x in splits]), F.col("split")).cast("int"),
    })


def safe_clip(df: DataFrame, p: str, cap_q: float = 0.995) -> DataFrame:
    """Predictions clipped to [0, cap]; cap = quantile of the finite ones, used for the non-finite."""
    clipped = F.greatest(F.col(p), F.lit(0.0))
    finite = F.when(F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")), clipped)
    # -inf is clipped to 0 before the finite test, so it counts as a finite 0.
    finite = F.when(F.col(p) == float("-inf"), 0.0).otherwise(finite)
    cap = F.coalesce(aggregate(df, [], {}, {"cap": (finite, cap_q)}).scalar(), F.lit(0.0))
    return df.withColumn(p, F.least(F.coalesce(finite, cap), cap))


def health(df: DataFrame, p: str) -> DataFrame:
    """Share of finite predictions, number of infinite ones, rows."""
    inf = F.coalesce(F.abs(p) == float("inf"), F.lit(False))
    bad = F.col(p).isNull() | F.isnan(p) | inf
    return df.agg(F.count("*").alias("n"), F.avg((~bad).cast("int")).alias("finite_share"),
                  F.count_if(inf).alias("n_inf"))


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Folds, mean and standard deviation of MAE and RMSE per model."""
    return fold_metrics.dropna(subset=["mae", "rmse"]).groupBy("model").agg(
        F.count_distinct("fold").alias("folds"), F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"))


def mean_baseline(df: DataFrame, target: str, train: Column, group: str = "ward") -> DataFrame:
    """Predict each group's training mean."""
    m = df.where(train).groupBy(group).agg(F.avg(target).alias("y_pred"))
    return df.join(m, group, "left")
