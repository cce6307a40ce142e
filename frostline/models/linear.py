"""Linear and log-linear models from summed cross products.

Every fit is a sequence of single passes: tasks add up X'WX and X'Wz of their rows with numpy,
Spark sums the k*k numbers over tasks, and a function over each group's sums solves its small
system. Coefficients stay a table (g, terms) of one row per group: the next pass joins them to the rows,
scoring does the same, and nothing but the question whether a group is still moving comes to the
driver. All groups (wards, folds) are fitted in the same passes; only those still moving are summed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.runtime import materialize, release

INTERCEPT = "(intercept)"
TERMS = "g string, terms array<double>"
STATE = "g string, terms array<double>, old array<double>, dev double, active boolean, alpha double"


def _key(group: str | Column) -> Column:
    return (F.col(group) if isinstance(group, str) else group).cast("string")


def summed(df: DataFrame, columns: list[str], group: str | Column, fn: Callable[[np.ndarray], np.ndarray],
           given: DataFrame | None = None, features: list[str] | None = None) -> DataFrame:
    """(g, pos, val): sum over all rows of each group of the flat vector ``fn(values)``.

    With ``given`` (g, terms, alpha) only its groups are summed, and each row carries behind its columns the linear
    predictor of ``features`` and alpha.
    """
    narrow = df.select(_key(group).alias("g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    used = [f"c{i}" for i in range(len(columns))]
    if given is not None:
        here = [f"c{columns.index(f)}" for f in features]
        narrow = narrow.join(given.select("g", "terms", "alpha"), "g").select(
            "g", *used, _dot("terms", here).alias("eta"), "alpha")
        used += ["eta", "alpha"]

    def part(batches):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False):
                v = fn(rows[used].to_numpy(dtype=float))
                acc[g] = acc[g] + v if g in acc else v
        for g, v in acc.items():
            yield pd.DataFrame({"g": g, "pos": np.arange(v.size, dtype=np.int32), "val": v})

    return narrow.where(F.col("g").isNotNull()).mapInPandas(part, "g string, pos int, val double").groupBy("g", "pos").agg(F.sum("val").alias("val"))


def _dot(terms: str, columns: list[str]) -> Column:
    return reduce(lambda a, i: a + F.col(terms)[i[0] + 1] * F.col(i[1]).cast("double"), enumerate(columns), F.col(terms)[0])


def _vector(rows: pd.DataFrame) -> np.ndarray:
    return rows.sort_values("pos")["val"].to_numpy()


def solved(sums: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(g, terms): ``fn`` of each group's sums, k*k numbers a group."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "terms": [[float(x) for x in fn(_vector(rows))]]})

    return sums.groupBy("g").applyInPandas(one, TERMS)


def _outer(v: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(v)), v])
    return (z.T @ z).ravel()


def means(df: DataFrame, target: str, group: str | Column) -> DataFrame:
    """(g, terms): the mean alone."""
    sums = summed(df, [target], group, lambda v: np.array([v.sum(), len(v)]))
    return solved(sums, lambda s: np.array([s[0] / s[1]]))


def vif(df: DataFrame, features: list[str], group: str | Column) -> DataFrame:
    """(g, feature, vif): variance inflation without intercept, from the uncentred R2 of each feature on the others."""
    def inflation(s: np.ndarray) -> list[float]:
        m = s.reshape(len(features) + 1, -1)[1:, 1:]
        scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        c = m / np.outer(scale, scale)
        out = []
        for i in range(len(features)):
            rest = [j for j in range(len(features)) if j != i]
            left = c[i, i] - c[i, rest] @ np.linalg.pinv(c[np.ix_(rest, rest)], rcond=1e-12, hermitian=True) @ c[rest, i]
            out.append(c[i, i] / left if left > 1e-10 else float("inf"))
        return out

    table = solved(summed(df, features, group, _outer), inflation)
    return table.select("g", F.posexplode("terms").alias("i", "vif")).select(
        "g", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("i") + 1).alias("feature"), "vif")


def ridge(df: DataFrame, features: list[str], target: str, group: str | Column, alpha: float = 1.0) -> DataFrame:
    """(g, terms): ridge with unpenalised intercept, exact from the centred cross products."""
    k = len(features) + 2
    return solved(summed(df, [*features, target], group, _outer), lambda s: ridge_from_gram(s.reshape(k, k), alpha))


def ridge_from_gram(m: np.ndarray, alpha: float) -> np.ndarray:
    """[intercept, coefficients] from Z'Z with Z = [1, features, target]."""
    n, s = m[0, 0], m[0, 1:]
    c = m[1:, 1:] - np.outer(s, s) / n
    beta = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(len(s) - 1), c[:-1, -1])
    return np.r_[(s[-1] - s[:-1] @ beta) / n, beta]


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of a possibly rank-deficient system, columns brought to one scale."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-11, hermitian=True) @ (b / d) / d


def _log_linear_sums(v: np.ndarray) -> np.ndarray:
    """X'WX (upper triangle), X'Wz, deviance and n of rows (features, target, linear predictor, alpha)."""
    x, y, a = np.column_stack([np.ones(len(v)), v[:, :-3]]), v[:, -3], v[0, -1]
    eta = np.clip(v[:, -2], -30, 30)  # inside the iteration only; scoring does not cut
    mu = np.exp(eta)
    xw = x * (mu / (1 + a * mu))[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        log_term = np.where(y > 0, y * np.log(y / mu), 0.0)
        dev = log_term - ((y + 1 / a) * np.log((1 + a * y) / (1 + a * mu)) if a > 0 else y - mu)
    return np.concatenate([(xw.T @ x)[np.triu_indices(x.shape[1])], xw.T @ (eta + (y - mu) / mu), [2 * dev.sum(), len(y)]])


def fit_log_linear(df: DataFrame, features: list[str], target: str, group: str | Column, alpha: float = 0.0,
                   start: DataFrame | None = None, max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """(g, terms, alpha): log-link count regression by iteratively reweighted least squares.

    ``alpha`` = 0 is Poisson, otherwise the variance is mu + alpha mu^2; ``start`` (g, terms, alpha) brings
    a first solution and an alpha for each group. The state of all groups is stored after every pass.
    """
    k, columns = len(features) + 1, [*features, target]
    if start is None:
        rest = F.array_repeat(F.lit(0.0), k - 1)
        start = means(df, target, group).select(
            "g", F.concat(F.array(F.log(F.greatest(F.col("terms")[0], F.lit(1e-6)))), rest).alias("terms"), F.lit(float(alpha)).alias("alpha"))
    state = materialize(start.select(
        "g", "terms", F.col("terms").alias("old"), F.lit(float("inf")).alias("dev"), F.lit(True).alias("active"), "alpha"), "fit")

    def step(sums: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        if sums.empty or now.empty:
            return now
        s, r = _vector(sums), now.iloc[0]
        beta, old, dev = np.array(r["terms"], float), np.array(r["old"], float), s[-2]
        done = np.isfinite(r["dev"]) and abs(r["dev"] - dev) < tol * (abs(dev) + 0.1)
        if not done and dev > r["dev"]:
            new, last, dev = (beta + old) / 2, old, r["dev"]  # overshoot: go half-way back
            done = np.max(np.abs(new - old)) < tol
            new = old if done else new
        else:
            last = beta
            try:
                whole = np.zeros((k, k))
                whole[np.triu_indices(k)] = s[:-k - 2]
                new = _solve(whole + np.triu(whole, 1).T, s[-k - 2:-2])  # if done, this step is the last
            except np.linalg.LinAlgError:  # sums that are not finite: this group has no solution
                new, done = np.full(k, np.nan), True
        return pd.DataFrame({"g": [r["g"]], "terms": [list(new)], "old": [list(last)], "dev": [dev], "active": [not done], "alpha": [r["alpha"]]})

    for _ in range(max_iter):
        sums = summed(df, columns, group, _log_linear_sums, state.where("active"), features)
        after = materialize(sums.groupBy("g").cogroup(state.groupBy("g")).applyInPandas(step, STATE), "fit")
        release(state)
        state = after
        if state.where("active").isEmpty():
            break
    return state.select("g", "terms", "alpha")


def fit_log_linear_many(df: DataFrame, features: list[str], target: str, group: Column, alphas: dict[str, float]) -> DataFrame:
    """(g, terms, alpha) with g = name|group: models that differ in ``alpha`` alone, of all groups, in the same passes."""
    keyed = df.withColumn("_model", F.explode(F.array(*[F.lit(n) for n in alphas]))).withColumn("_key", F.concat_ws("|", "_model", group.cast("string")))
    alpha = reduce(lambda a, n: a.when(F.col("g").startswith(f"{n}|"), F.lit(float(alphas[n]))), alphas, F)
    rest = F.array_repeat(F.lit(0.0), len(features))
    start = means(keyed, target, "_key").select(
        "g", F.concat(F.array(F.log(F.greatest(F.col("terms")[0], F.lit(1e-6)))), rest).alias("terms"), alpha.alias("alpha"))
    return fit_log_linear(keyed, features, target, "_key", start=start)


def _dispersion_loglik(half: float, points: int) -> Callable[[np.ndarray], np.ndarray]:
    """Log-likelihood at ``points`` dispersions around each group's (log alpha in the alpha column)."""
    def fn(v):
        y, mu, center = v[:, 0], np.exp(np.clip(v[:, -2], -30, 30)), v[0, -1]
        levels, where = np.unique(y, return_inverse=True)
        out = []
        for a in np.exp(np.linspace(center - half, center + half, points)):
            r = 1 / a
            const = np.array([lgamma(t + r) - lgamma(r) - lgamma(t + 1) for t in levels])[where]
            out.append((const - r * np.log1p(a * mu) + y * (np.log(a * mu) - np.log1p(a * mu))).sum())
        return np.array(out)

    return fn


def fit_negbin(df: DataFrame, features: list[str], target: str, group: str | Column, rounds: int = 5, points: int = 9) -> DataFrame:
    """(g, terms, alpha): negative binomial with estimated dispersion.

    Alternates coefficient fits with a log-likelihood scan over a shrinking grid of
    dispersions, all groups at once.
    """
    found, half = fit_log_linear(df, features, target, group), 8.0
    center = found.select("g", "terms", F.lit(0.0).alias("alpha"))  # log of the dispersion
    for _ in range(rounds):
        spacing = 2 * half / (points - 1)
        scan = summed(df, [target, *features], group, _dispersion_loglik(half, points), center, features)
        best = scan.groupBy("g").agg(F.min_by("pos", F.struct(-F.col("val"), "pos")).alias("at"))
        moved = center.join(best, "g").select("g", "terms", (F.col("alpha") - half + F.col("at") * spacing).alias("center"))
        half *= 2 / (points - 1) * 1.5
        moved = materialize(moved, "dispersion")
        found = fit_log_linear(df, features, target, group, start=moved.select("g", "terms", F.exp("center").alias("alpha")), max_iter=25)
        center = found.join(moved.select("g", "center"), "g").select("g", "terms", F.col("center").alias("alpha"))
    return found


def linear_score(features: list[str], terms: DataFrame, df: DataFrame, group: str | Column, link: str = "identity",
                 name: str = "y_pred") -> DataFrame:
    """Append the prediction: coefficients joined by group, dot product on the JVM side.

    An unknown group or a missing feature gives null, not 0."""
    table = terms.select(F.col("g").alias("_g"), F.col("terms").alias("_b"))
    dot = _dot("_b", features)
    value = F.exp(dot) if link == "log" else dot  # a runaway prediction stays visible
    return df.join(table, _key(group) == F.col("_g"), "left").withColumn(
        name, F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))).drop("_g", "_b")


def as_dict(table: DataFrame) -> dict[str, np.ndarray]:
    """A small table of terms on the driver, for looking at it."""
    return {r["g"]: np.array(r["terms"]) for r in table.collect()}
