"""Correlations, lagged regressions and dispersion from one-pass moments."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.operators.timeseries import by_area, forward_sum_inclusive


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null if either is constant.

    Built from covariance and deviations because ``corr`` raises on a constant column.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(df: DataFrame, columns: list[str], area: str = "ward") -> DataFrame:
    """Long form (area, a, b, corr) of all ordered pairs, from one aggregation."""
    pairs = list(combinations(columns, 2))
    agg = df.groupBy(area).agg(
        *[pearson(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
        *[F.when(F.var_pop(c) > 0, 1.0).alias(f"d{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"d{i}").alias("corr"))
              for i, c in enumerate(columns)]
    return agg.select(area, F.explode(F.array(*cells)).alias("r")).select(area, "r.*")


def correlation_with(df: DataFrame, features: list[str], target: str, area: str = "ward") -> DataFrame:
    """(area, feature, corr) against the target; a constant column gives 0."""
    agg = df.groupBy(area).agg(*[
        F.coalesce(pearson(F.col(c), F.col(target)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(features)])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(features)]
    return agg.select(area, F.explode(F.array(*cells)).alias("r")).select(area, "r.*")


def lag_grid(df: DataFrame, y: str, p: str, f: str, forward: int, p_lags: int = 10, f_lags: int = 10,
             area: str = "ward") -> DataFrame:
    """R2 and n of  y_forward ~ 1 + p(t-a) + f(t-b)  for every lag pair, all areas in one job.

    Each row carries its lags once; exploded pairs are reduced to moments before any shuffle.
    """
    w = by_area(area)
    d = df.select(
        area, forward_sum_inclusive(F.col(y), w, forward).cast("double").alias("y"),
        F.array(*[F.lag(p, a).over(w).cast("double") for a in range(p_lags)]).alias("ps"),
        F.array(*[F.lag(f, b).over(w).cast("double") for b in range(f_lags)]).alias("fs"),
    ).where(F.col("y").isNotNull())
    long = (
        d.select(area, "y", F.posexplode("ps").alias("a", "p"), "fs")
        .select(area, "y", "a", "p", F.posexplode("fs").alias("b", "f"))
        .where(F.col("p").isNotNull() & F.col("f").isNotNull())
    )
    m = long.groupBy(area, "a", "b").agg(
        F.count("*").alias("n"), F.var_pop("y").alias("yy"), F.var_pop("p").alias("pp"), F.var_pop("f").alias("ff"),
        F.covar_pop("p", "f").alias("pf"), F.covar_pop("p", "y").alias("py"), F.covar_pop("f", "y").alias("fy"))
    yy, pp, ff, pf, py, fy = (F.col(c) for c in ("yy", "pp", "ff", "pf", "py", "fy"))
    det = pp * ff - pf * pf
    r2 = (
        F.when(yy <= 0, 0.0)
        .when(det > 1e-12 * pp * ff, (py * py * ff - 2 * py * fy * pf + fy * fy * pp) / (det * yy))
        .when(pp > 0, py * py / (pp * yy))
        .when(ff > 0, fy * fy / (ff * yy))
        .otherwise(0.0)
    )
    return m.select(area, "a", "b", "n", r2.alias("r2"))


def lag_regression(df: DataFrame, y: str, x: str, forward: int, lags: int = 20, area: str = "ward") -> DataFrame:
    """n, intercept, slope, R2 and correlation of  y_forward ~ 1 + x(t-b)  per lag."""
    w = by_area(area)
    d = df.select(
        area, forward_sum_inclusive(F.col(y), w, forward).cast("double").alias("y"),
        F.array(*[F.lag(x, b).over(w).cast("double") for b in range(lags)]).alias("xs"),
    ).where(F.col("y").isNotNull())
    long = d.select(area, "y", F.posexplode("xs").alias("lag", "x")).where(F.col("x").isNotNull())
    m = long.groupBy(area, "lag").agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_pop("y").alias("yy"),
        F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"))
    slope = F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0))
    corr = F.coalesce(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0))
    return m.select(area, "lag", "n", (F.col("my") - slope * F.col("mx")).alias("intercept"), slope.alias("slope"),
                    (corr * corr).alias("r2"), corr.alias("corr"))


def best_lag(results: DataFrame, area: str = "ward") -> DataFrame:
    """Each area's row with the highest R2 (lowest lag on ties)."""
    best = F.max_by(F.struct("lag", "n", "intercept", "slope", "r2", "corr"), F.struct(F.col("r2"), -F.col("lag")))
    return results.groupBy(area).agg(best.alias("b")).select(area, "b.*")


def dispersion(df: DataFrame, value: str, area: str = "ward") -> DataFrame:
    return df.groupBy(area).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
        F.try_divide(F.var_samp(value), F.avg(value)).alias("dispersion"))


def level_stats(df: DataFrame, level: str, value: str, area: str = "ward") -> DataFrame:
    return df.groupBy(area, level).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
