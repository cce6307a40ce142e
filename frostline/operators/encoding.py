"""Level and scale encodings that are learned on the training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.runtime import scalars

def train_levels(train: DataFrame, column: str) -> list[str]:
    """Sorted distinct levels. Each becomes a column of the encoding, so the driver holds no more than the names of its columns."""
    return sorted(r[0] for r in train.select(column).dropna().distinct().collect())


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """0/1 column per training level; unseen levels get zeros everywhere."""
    return df.withColumns({
        f"{column}_{v}".replace(" ", "_"): F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in levels})


def standardize(df: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """(x - train mean) / train population std; a constant column is only centred."""
    s = scalars(train.agg(*[f(c).alias(f"{a}_{c}") for c in columns
                            for a, f in (("m", F.avg), ("s", F.stddev_pop))]))

    def scaled(c: str):
        sd = F.col(f"_s.s_{c}")
        return (F.col(c) - F.col(f"_s.m_{c}")) / F.when(sd > 0, sd).otherwise(F.lit(1.0))

    return df.withColumn("_s", s).withColumns({c: scaled(c) for c in columns}).drop("_s")
