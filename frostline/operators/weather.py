"""Hourly to daily to weekly weather and 15-day look-backs, all areas at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.clean import nan_to_null, weather_flags
from frostline.functions.dates import week_start


def daily_weather(hourly: DataFrame, area: str = "ward") -> DataFrame:
    """One row per area and day between its first and last hour.

    Days without hours have sums 0 and null temperatures.
    """
    t = nan_to_null(F.col("temperature_2m"))
    days = (
        hourly.groupBy(area, F.to_date("ts").alias("date"))
        .agg(F.max(t).alias("tmax_c"), F.min(t).alias("tmin_c"), F.avg(t).alias("tmean_c"),
             F.sum(nan_to_null(F.col("precipitation"))).alias("precip_mm"),
             F.sum(nan_to_null(F.col("snowfall"))).alias("snow_cm"))
    )
    # A day is followed by a gap when the next day with data is later than tomorrow:
    # emit the day itself plus the missing days after it, without a second pass or join.
    nxt = F.lead("date").over(Window.partitionBy(area).orderBy("date"))
    until = F.coalesce(F.date_sub(nxt, 1), F.col("date"))
    here = F.col("date") == F.col("day")
    return (
        days.withColumn("until", until)
        .withColumn("day", F.explode(F.sequence("date", "until")))
        .select(
            area, F.col("day").alias("date"),
            *[F.when(here, F.col(c)).alias(c) for c in ("tmax_c", "tmin_c", "tmean_c")],
            *[F.when(here, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
              for c in ("precip_mm", "snow_cm")])
    )


def lookback_sum(daily: DataFrame, targets: DataFrame, value: str, name: str, days: int = 15,
                 area: str = "ward") -> DataFrame:
    """Per target day the sum over the ``days`` days before it (0 if there are none).

    The window edges are midnights, so summing daily sums over a RANGE frame of day numbers
    gives the hour-level interval join without multiplying any rows.
    """
    both = (
        daily.select(area, "date", F.col(value).alias("v"), F.lit(False).alias("is_target"))
        .unionByName(targets.select(area, "date", F.lit(None).cast("double").alias("v"),
                                    F.lit(True).alias("is_target")))
        .groupBy(area, "date").agg(F.sum("v").alias("v"), F.bool_or("is_target").alias("is_target"))
    )
    w = Window.partitionBy(area).orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    return (
        both.withColumn(name, F.coalesce(F.sum("v").over(w), F.lit(0.0)))
        .where("is_target").select(area, "date", name)
    )


def weekly_weather(daily: DataFrame, area: str = "ward") -> DataFrame:
    """Twelve weekly aggregates of a daily table with flags and look-backs."""
    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0))

    return daily.groupBy(area, week_start(F.col("date")).alias("week")).agg(
        total("precip_mm").alias("precip_mm_sum"),
        total("snow_cm").alias("snow_cm_sum"),
        F.avg("tmax_c").alias("tmax_c_mean"),
        F.avg("tmin_c").alias("tmin_c_mean"),
        F.avg("tmean_c").alias("tmean_c_mean"),
        F.avg("t_range").alias("t_range_mean"),
        total("freeze_day").alias("freeze_days"),
        total("freeze_thaw_day").alias("freeze_thaw_days"),
        total("heavy_rain_day").alias("heavy_rain_days"),
        F.avg("ftc_15d").alias("ftc_15d_mean"),
        F.max("ftc_15d").alias("ftc_15d_max"),
        F.avg("precip_15d").alias("precip_15d_mean"),
    )


WEEKLY_COLUMNS = [
    "precip_mm_sum", "snow_cm_sum", "tmax_c_mean", "tmin_c_mean", "tmean_c_mean", "t_range_mean",
    "freeze_days", "freeze_thaw_days", "heavy_rain_days", "ftc_15d_mean", "ftc_15d_max", "precip_15d_mean",
]


def enriched_daily(hourly: DataFrame, heavy_rain_mm: float = 10.0, lookback_days: int = 15) -> DataFrame:
    """Daily weather with flags, windowed freeze-thaw count and look-back precipitation."""
    from frostline.operators.freeze_thaw import windowed_ftc

    daily = weather_flags(daily_weather(hourly), heavy_rain_mm)
    targets = daily.select("ward", "date")
    ftc = windowed_ftc(hourly, targets, lookback_days)
    rain = lookback_sum(daily, targets, "precip_mm", "precip_15d", lookback_days)
    return daily.join(ftc, ["ward", "date"], "left").join(rain, ["ward", "date"], "left")
