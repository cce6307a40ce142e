"""Reproducible stratified splits and folds, decided on the calendar and joined by date.

Ranking happens on distinct days only, so its size is bounded by the calendar and a day
keeps its split whatever rows later survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.operators.topn import hash_order


def _ranked_days(df: DataFrame, seed: int, date: str) -> DataFrame:
    days = df.select(date).where(F.col(date).isNotNull()).distinct().withColumn("quarter", F.quarter(date))
    q = Window.partitionBy("quarter")
    return days.withColumns({
        "r": F.row_number().over(q.orderBy(hash_order(seed, date), date)),
        "n": F.count("*").over(q),
    })


def split_days(df: DataFrame, seed: int = 42, val_frac: float = 0.15, test_frac: float = 0.15,
               date: str = "date") -> DataFrame:
    """(date, quarter, split): within each calendar quarter, fixed rounded fractions."""
    n_test = F.floor(F.col("n") * test_frac + 0.5)
    n_val = F.floor(F.col("n") * val_frac + 0.5)
    return _ranked_days(df, seed, date).select(
        date, "quarter",
        F.when(F.col("r") <= n_test, "test").when(F.col("r") <= n_test + n_val, "val")
        .otherwise("train").alias("split"))


def make_split(features: DataFrame, calendar: DataFrame | None = None, seed: int = 42,
               val_frac: float = 0.15, test_frac: float = 0.15) -> DataFrame:
    """Append the split column; ``calendar`` is the full set of days (default: the rows' own)."""
    days = split_days(features if calendar is None else calendar, seed, val_frac, test_frac)
    return features.join(days.select("date", "split"), "date")


def fold_days(df: DataFrame, k: int = 5, seed: int = 42, date: str = "date") -> DataFrame:
    """(date, quarter, fold): days dealt out in turn inside each quarter."""
    return _ranked_days(df, seed, date).select(date, "quarter", F.pmod(F.col("r") - 1, F.lit(k)).cast("int").alias("fold"))
