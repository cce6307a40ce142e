"""Registration of queries together with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.catalog.sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Register a (spark, sf_dir) -> DataFrame callable, with its SQL if there is one."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = compose(sql, *needs)
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as bigint and small ints widened: one result type per kind."""
    def fix(name: str, dtype: str):
        c = F.col(name)
        if dtype == "double":
            return F.round(c, digits).alias(name)
        if dtype in ("int", "smallint", "tinyint"):
            return c.cast("bigint").alias(name)
        if dtype == "boolean":
            return c.cast("bigint").alias(name)
        return c

    return df.select(*[fix(n, t) for n, t in df.dtypes])
