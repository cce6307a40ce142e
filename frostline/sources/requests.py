"""Request files: scan, column normalisation, union over years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.clean import to_number, to_ts
from frostline.schema import REQUEST_CANDIDATES


def find_col(columns, candidates: list[str]) -> str | None:
    """First candidate present in ``columns``."""
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def normalize_names(df: DataFrame) -> DataFrame:
    """Strip, upper-case, spaces to underscores."""
    return df.toDF(*[c.strip().upper().replace(" ", "_") for c in df.columns])


def canonical(df: DataFrame) -> DataFrame:
    """Select the first present candidate of every canonical field under its canonical name."""
    d = normalize_names(df)
    found = {k: find_col(d.columns, cands) for k, cands in REQUEST_CANDIDATES.items()}
    return d.select(*[F.col(c).alias(k) for k, c in found.items() if c])


def coerce(df: DataFrame, ts_format: str | None = None) -> DataFrame:
    """Timestamps and coordinates from text; what does not parse becomes null."""
    typed = {c: to_ts(F.col(c), ts_format) for c in ("add_ts", "due_ts", "resolved_ts") if c in df.columns}
    typed |= {c: to_number(F.col(c)) for c in ("lat", "lon") if c in df.columns}
    return df.withColumns(typed) if typed else df


def read_requests(spark: SparkSession, path: str, ts_format: str | None = None) -> DataFrame:
    """A request CSV: only the header is read up front, all columns are text until coerced.

    Every file of a folder must have the same header: one that differs fails the read, because its
    columns would land in the wrong fields. Files of other headers are read apart and united by ``union_years``."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    return coerce(canonical(raw), ts_format)


def union_years(frames: list[DataFrame]) -> DataFrame:
    """One table over files whose columns differ; missing fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def daily_request_counts(requests: DataFrame, service: str, start: str, end: str) -> DataFrame:
    """Zero-filled daily counts of exactly one service, per ward."""
    from frostline.operators.timeseries import zero_filled_daily

    per_day = (
        requests.where((F.col("service") == service) & F.col("ward").isNotNull())
        .groupBy("ward", F.to_date("add_ts").alias("date")).agg(F.count("*").alias("y"))
    )
    return zero_filled_daily(per_day, "ward", start, end, "y")
