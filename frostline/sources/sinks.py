"""Results on storage: hourly tables with provenance, ranked sweeps, metrics.

Fitted models are stored by ``frostline.models.registry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.schema import DAILY_FILE_SCHEMA, STATION_SCHEMA


def save_hourly(hourly: DataFrame, metadata: DataFrame, path: str, area: str = "ward") -> None:
    """Hourly rows partitioned by area, metadata with the time of saving."""
    hourly.write.mode("overwrite").partitionBy(area).parquet(f"{path}/hourly.parquet")
    metadata.withColumn("saved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")) \
        .write.mode("overwrite").json(f"{path}/metadata")


def load_hourly(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    from frostline.schema import METADATA_SCHEMA

    return spark.read.parquet(f"{path}/hourly.parquet"), spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata")


def save_ranked(results: DataFrame, path: str, *order: Column) -> None:
    """Sweep results in score order."""
    results.orderBy(*order).write.mode("overwrite").parquet(path)


def load_top(spark: SparkSession, path: str, k: int, *order: Column) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order).limit(k)


def append_metrics(metrics: DataFrame, path: str, model: str, stage: str) -> None:
    metrics.withColumns({"model": F.lit(model), "stage": F.lit(stage), "saved_at": F.current_timestamp()}) \
        .write.mode("append").parquet(path)


def record_metrics(metrics: DataFrame, path: str, run: str, model: str, stage: str) -> None:
    """Metrics of one stage of a run, in a partition of their own: writing them again replaces them, and nothing else."""
    metrics.withColumns({"run": F.lit(run), "model": F.lit(model), "stage": F.lit(stage), "saved_at": F.current_timestamp()}) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "model", "stage").parquet(path)


def save_station_files(daily: DataFrame, stations: DataFrame, path: str, station: str = "ward") -> None:
    """Daily rows as one file per station: the station's header and values, an empty line, the header and values of its days.

    ``daily`` holds the station and the columns of a daily file, ``stations`` the station and those of a station line; a
    column that is missing stays empty. A file holds one station's days, so its size is bounded by the calendar.
    """
    def line(df: DataFrame, names: list[str]) -> Column:
        return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in names])

    place, day = STATION_SCHEMA.fieldNames(), DAILY_FILE_SCHEMA.fieldNames()
    heads = stations.select(station, F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.lit(",".join(place)).alias("value")), F.struct(F.lit(1).alias("at"), line(stations, place).alias("value")),
        F.struct(F.lit(2).alias("at"), F.lit("").alias("value")), F.struct(F.lit(3).alias("at"), F.lit(",".join(day)).alias("value")))).alias("l")).select(station, "l.*")
    rows = daily.select(station, F.lit(4).alias("at"), line(daily, day).alias("value"))
    heads.union(rows).repartition(station).sortWithinPartitions(station, "at", "value").select(station, "value") \
        .write.mode("overwrite").partitionBy(station).text(path)


def save_metadata(records: DataFrame, path: str, area: str = "ward") -> None:
    """Provenance records, one JSON document per area."""
    records.repartition(area).write.mode("overwrite").partitionBy(area).json(path)
