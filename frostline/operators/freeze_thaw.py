"""Freeze-thaw cycles: run detection on hourly temperatures.

Runs are over row adjacency after sorting by time, per area: a missing hour does not end a
run. A cycle is a freeze run of at least ``min_hours`` whose next qualifying run (short and
neutral runs dropped) is a thaw run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.clean import nan_to_null


def hour_label(temp: Column, thaw: float = 4.0) -> Column:
    """F below zero, T above the thaw threshold, else N (also for null and NaN)."""
    t = nan_to_null(temp)
    return F.when(t < 0, "F").when(t > thaw, "T").otherwise("N")


def labelled_runs(hourly: DataFrame, thaw: float = 4.0, area: str = "ward") -> DataFrame:
    """Hours with their label and a run number that grows with time inside the area."""
    w = Window.partitionBy(area).orderBy("ts")
    starts = (F.col("label") != F.lag("label", 1, "").over(w)).cast("int")
    return (
        hourly.select(area, "ts", hour_label(F.col("temperature_2m"), thaw).alias("label"))
        .withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("starts")
    )


def daily_ftc(hourly: DataFrame, min_hours: int = 4, thaw: float = 4.0, area: str = "ward") -> DataFrame:
    """Cycles per area and day, dated by the last hour of the thaw run; days without are absent."""
    runs = (
        labelled_runs(hourly, thaw, area).groupBy(area, "run", "label")
        .agg(F.count("*").alias("hours"), F.max("ts").alias("end_ts"))
        .where((F.col("label") != "N") & (F.col("hours") >= min_hours))
    )
    before = F.lag("label").over(Window.partitionBy(area).orderBy("run"))
    return (
        runs.withColumn("before", before)
        .where((F.col("label") == "T") & (F.col("before") == "F"))
        .groupBy(area, F.to_date("end_ts").alias("date")).agg(F.count("*").alias("ftc"))
    )


def windowed_ftc(hourly: DataFrame, targets: DataFrame, days: int = 15, min_hours: int = 4,
                 thaw: float = 4.0, area: str = "ward", name: str = "ftc_15d") -> DataFrame:
    """Cycles inside the ``days`` days before each target day, runs cut at the window's edges.

    Edges are midnights, so a run is first reduced to its hours per day; those few pieces,
    not the hours, are sent to the targets they fall into.
    """
    pieces = (
        labelled_runs(hourly, thaw, area).where(F.col("label") != "N")
        .groupBy(area, "run", "label", F.to_date("ts").alias("day")).agg(F.count("*").alias("hours"))
    )
    ahead = F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days)))
    clipped = (
        pieces.withColumn("date", ahead)
        .groupBy(area, "date", "run", "label").agg(F.sum("hours").alias("hours"))
        .where(F.col("hours") >= min_hours)
    )
    before = F.lag("label").over(Window.partitionBy(area, "date").orderBy("run"))
    cycles = (
        clipped.withColumn("before", before)
        .groupBy(area, "date")
        .agg(F.count_if((F.col("label") == "T") & (F.col("before") == "F")).alias(name))
    )
    return (
        targets.select(area, "date").join(cycles, [area, "date"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    )


def count_cycles(hourly: DataFrame, min_hours: int = 4, thaw: float = 4.0, area: str = "ward") -> DataFrame:
    """Cycles of each area's whole series; 0 where there are hours but no cycle."""
    per_day = daily_ftc(hourly, min_hours, thaw, area).groupBy(area).agg(F.sum("ftc").alias("ftc"))
    return (
        hourly.select(area).distinct().join(per_day, area, "left")
        .withColumn("ftc", F.coalesce("ftc", F.lit(0)))
    )
