"""Parameter grids and their evaluation as one Spark job.

A candidate's feature matrix only combines columns from a small set (targets per horizon,
rolling sums per width and shift, lags, calendar). Spark groups the work by (area, slice of
the candidates); a task holds one area's daily series – bounded by its calendar – and its
slice, derives each distinct column once and scores the candidates in batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.schema import CALENDAR_FEATURES, FEATURE_PARAMS, PARAM_GRID, PARAM_RANGES

MIN_TRAIN, MIN_VAL = 10, 5
FAMILIES = {"precip": ("daily_precip", "d_p", "l_p"), "snow": ("daily_snow", "d_s", "l_s"),
            "ftc": ("daily_ftc", "d_f", "l_f")}
SERIES = ["pothole_count", "daily_precip", "daily_snow", "daily_ftc", *CALENDAR_FEATURES]


def param_grid(areas: DataFrame, grid: dict[str, list[int]] = PARAM_GRID) -> DataFrame:
    """Every combination of the candidate lists for every area row, by exploding literals."""
    out = areas
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def random_candidates(areas: DataFrame, n: int, ranges: dict[str, tuple[int, int]] = PARAM_RANGES,
                      seed: int = 42) -> DataFrame:
    """``n`` seeded candidates per area, uniform in inclusive integer ranges."""
    trial = areas.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = {
        name: (F.lit(lo) + F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "trial"), F.lit(hi - lo + 1))).cast("int")
        for name, (lo, hi) in ranges.items()}
    return trial.select(*areas.columns, *[c.alias(n) for n, c in draws.items()])


def _rolling(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sum over rows t+first .. t+last; NaN unless all of them exist and hold a value."""
    n, width = len(x), last - first + 1
    total = np.concatenate([[0.0], np.cumsum(np.where(np.isnan(x), 0.0, x))])
    known = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    lo = np.arange(n) + first
    hi = lo + width
    inside = (lo >= 0) & (hi <= n)
    lo, hi = np.where(inside, lo, 0), np.where(inside, hi, 0)
    return np.where(inside & (known[hi] - known[lo] == width), total[hi] - total[lo], np.nan)


def _derived(days: pd.DataFrame, used: pd.DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """The distinct feature columns that the candidates ``used`` combine, and their positions."""
    x = {c: days[c].to_numpy(dtype=float) for c in SERIES}
    out = {}
    for d in used["d"].unique():
        out[f"Y:{d}"] = _rolling(x["pothole_count"], 1, int(d))
    for fam, (src, width, shift) in FAMILIES.items():
        for w, s in used[[width, shift]].drop_duplicates().itertuples(index=False):
            out[f"{fam}:{w}:{s}"] = _rolling(x[src], -int(s + w - 1), -int(s))
    for k in range(1, int(used["k_AR"].max()) + 1):
        out[f"lag:{k}"] = _rolling(x["pothole_count"], -k, -k)
    out |= {c: x[c] for c in CALENDAR_FEATURES}
    return np.column_stack(list(out.values())), {n: i for i, n in enumerate(out)}


def candidate_columns(p: dict, index: dict[str, int]) -> list[int]:
    """Positions of one candidate's features, its target last."""
    return [
        *[index[f"{fam}:{p[w]}:{p[s]}"] for fam, (_, w, s) in FAMILIES.items()],
        *[index[f"lag:{k}"] for k in range(1, p["k_AR"] + 1)], *[index[c] for c in CALENDAR_FEATURES], index[f"Y:{p['d']}"],
    ]


def _score(series: np.ndarray, is_train: np.ndarray, is_val: np.ndarray, cols: np.ndarray, alpha: float
           ) -> tuple[np.ndarray, np.ndarray]:
    """Validation MAE and Poisson deviance of a batch of same-width candidates (last column = target).

    The cross products of training rows without any gap are summed once; a candidate adds
    only the few remaining rows that are complete in its own columns.
    """
    gaps = np.isnan(series)
    z = np.column_stack([np.ones(len(series)), np.where(gaps, 0.0, series)])
    cols = np.column_stack([np.zeros(len(cols), dtype=int), cols + 1])  # column 0 is the constant
    whole = is_train & ~gaps.any(axis=1)
    core = z[whole].T @ z[whole]
    rest = is_train & ~whole
    m = core[cols[:, :, None], cols[:, None, :]]
    if rest.any():
        part = z[rest][:, cols].transpose(1, 0, 2)
        ok = ~gaps[rest][:, cols[:, 1:] - 1].any(axis=2).T
        part = part * ok[:, :, None]
        m = m + part.transpose(0, 2, 1) @ part
    n_train = m[:, 0, 0]
    n = np.maximum(n_train, 1.0)[:, None, None]
    c = m[:, 1:, 1:] - m[:, 1:, :1] * m[:, :1, 1:] / n
    k = c.shape[1] - 1
    beta = np.linalg.solve(c[:, :k, :k] + alpha * np.eye(k), c[:, :k, k:])[:, :, 0]
    b0 = (m[:, 0, -1] - (m[:, 0, 1:-1] * beta).sum(axis=1)) / n[:, 0, 0]
    v = z[is_val][:, cols].transpose(1, 0, 2)
    ok = ~gaps[is_val][:, cols[:, 1:] - 1].any(axis=2).T
    pred = np.maximum((v[:, :, 1:-1] @ beta[:, :, None])[:, :, 0] + b0[:, None], 0.0)
    y = v[:, :, -1]
    n_val = ok.sum(axis=1)
    mu = np.maximum(pred, 1e-8)
    log_term = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
    div = np.maximum(n_val, 1)
    mae = (np.abs(y - pred) * ok).sum(axis=1) / div
    dev = 2 * ((log_term - (y - mu)) * ok).sum(axis=1) / div
    bad = (n_train < MIN_TRAIN) | (n_val < MIN_VAL)
    return np.where(bad, np.inf, mae), np.where(bad, np.inf, dev)


def evaluate_candidates(master: DataFrame, candidates: DataFrame, alpha: float = 1.0,
                        slices: int = 16, batch: int = 256) -> DataFrame:
    """Candidates (ward, parameters) with val_mae and val_poisson_dev of a ridge fit.

    ``master`` carries the split column; too few rows score +infinity. An area's days are
    sent to each slice of its candidates, so work spreads over areas x slices tasks. The
    partition number is given because the rows are few but each is costly: left to its
    size, the shuffle would be merged into a handful of tasks.
    """
    spark = master.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left = candidates.withColumn("slice", F.pmod(F.xxhash64(*FEATURE_PARAMS), F.lit(slices)).cast("int"))
    right = master.select(F.col("ward").alias("area"), "date", "split", *SERIES).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(cand: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        out = cand.drop(columns="slice").assign(val_mae=np.inf, val_poisson_dev=np.inf)
        if cand.empty or days.empty:
            return out
        days = days.sort_values("date")
        train, val = (days["split"] == "train").to_numpy(), (days["split"] == "val").to_numpy()
        # Candidates of one lag depth and horizon have matrices of one shape and few gaps.
        for _, same in out.groupby(["k_AR", "d"]):
            series, index = _derived(days, same)
            spec = [candidate_columns(r, index) for r in same[FEATURE_PARAMS].to_dict("records")]
            for i in range(0, len(spec), batch):
                mae, dev = _score(series, train, val, np.array(spec[i:i + batch]), alpha)
                rows = same.index[i:i + batch]
                out.loc[rows, "val_mae"], out.loc[rows, "val_poisson_dev"] = mae, dev
        return out

    schema = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + ", val_mae double, val_poisson_dev double"
    left, right = left.repartition(tasks, "ward", "slice"), right.repartition(tasks, "area", "part")
    return left.groupBy("ward", "slice").cogroup(right.groupBy("area", "part")).applyInPandas(run, schema)


def run_grid(master: DataFrame, grid: dict[str, list[int]] = PARAM_GRID, alpha: float = 1.0) -> DataFrame:
    areas = master.select("ward").distinct()
    return evaluate_candidates(master, param_grid(areas, grid), alpha)


def ranking() -> list:
    """Best first; equal scores in parameter order."""
    return [F.col("val_mae"), *[F.col(p) for p in FEATURE_PARAMS]]


def top_per_area(results: DataFrame, k: int) -> DataFrame:
    from frostline.operators.topn import top_n_per_group

    return top_n_per_group(results, ["ward"], k, ranking(), salts=16, salt_by=FEATURE_PARAMS)


def run_search(master: DataFrame, trials: int = 200, warm: DataFrame | None = None, seed: int = 42,
               alpha: float = 1.0) -> DataFrame:
    """Random candidates plus an optional warm start (ward, parameters), all scored alike."""
    areas = master.select("ward").distinct()
    cand = random_candidates(areas, trials, seed=seed)
    if warm is not None:
        cand = warm.select("ward", *FEATURE_PARAMS).unionByName(cand)
    cand = cand.distinct()
    return evaluate_candidates(master, cand, alpha)
