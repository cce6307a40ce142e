"""Weather files: hourly tables, station daily files, provenance records, type features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.schema import DAILY_FILE_SCHEMA, HOURLY_SCHEMA, METADATA_SCHEMA, STATION_SCHEMA


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Hourly weather, parquet or CSV by suffix; the time column is named ``ts``."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).schema(HOURLY_SCHEMA).csv(path)
    return df.withColumnRenamed("date", "ts")


def read_station_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily station files with a two-row preamble; the station's columns are joined back.

    Every line is a row of its own, so files of any number and size are read in parallel:
    data lines start with a date, the station line with a coordinate. They meet by full path, so
    folders may hold files of one name.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), "value")
    data = lines.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2},")).select(
        "path", F.from_csv("value", DAILY_FILE_SCHEMA.simpleString()[7:-1].replace(":", " ")).alias("d"))
    station = lines.where(F.col("value").rlike(r"^-?\d+(\.\d+)?,-?\d+")).select(
        "path", F.from_csv("value", STATION_SCHEMA.simpleString()[7:-1].replace(":", " ")).alias("s"))
    rows = data.join(station, "path", "left").withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    return rows.select(
        "file", F.concat(F.lit("Ward "), F.regexp_extract("file", r"ward(\d+)", 1)).alias("ward"), "d.*", "s.*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Provenance records, one JSON document per file."""
    return spark.read.option("multiLine", True).schema(METADATA_SCHEMA).json(path)


def read_type_features(spark: SparkSession, path: str) -> DataFrame:
    """Service-type feature file; its repeated column name is resolved by position."""
    df = spark.read.option("header", True).csv(path)
    names, seen = [], {}
    for c in df.columns:
        base = c.rstrip("0123456789") if c.startswith("n_requests") else c
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    d = df.toDF(*names)
    return d.select(names[0], *[F.col(c).try_cast("double").alias(c) for c in names[1:]])


def with_station_records(hourly: DataFrame, records: DataFrame, area: str = "ward") -> DataFrame:
    """Hours with the records of their station that are valid on their day, a row per variable that such a record names.

    A record holds from its start to its end date, both included; hours outside every span keep nulls.
    """
    valid = records.select(
        F.col(area).alias("_area"), F.to_date("start_date").alias("_from"), F.to_date("end_date").alias("_to"), "label", "description",
        "latitude", "longitude", F.explode_outer("variables").alias("variable"))
    day = F.to_date("ts")
    return hourly.join(valid, (F.col(area) == F.col("_area")) & (day >= F.col("_from")) & (day <= F.col("_to")), "left").drop("_area", "_from", "_to")
