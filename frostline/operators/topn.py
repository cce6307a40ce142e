"""Top-k, top-n per group and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_n_per_group(df: DataFrame, group: list[str], n: int, order: list[Column], salts: int = 0,
                    salt_by: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group in a total order.

    With ``salts`` the rows of a group are first cut to ``n`` inside ``salts`` hash slices,
    so the final ranking of a hot group reads at most ``n * salts`` rows.
    """
    if salts:
        slice_ = F.pmod(F.xxhash64(*(salt_by or df.columns)), F.lit(salts))
        w = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", slice_).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n).drop("_rn", "_slice"))
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop(name)


def hash_order(seed: int | str, *keys: str) -> Column:
    """Seeded pseudo-random order that depends only on the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows; the same rows for the same seed whatever the partitioning."""
    return df.orderBy(hash_order(seed, *key), *key).limit(n)


def sample_per_group(df: DataFrame, group: list[str], n: int, key: list[str], seed: int = 42,
                     salts: int = 64) -> DataFrame:
    order = [hash_order(seed, *key), *[F.col(k) for k in key]]
    return top_n_per_group(df, group, n, order, salts=salts, salt_by=key)
