"""Daily master series, feature assembly and the daily model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.clean import weather_flags
from frostline.functions.dates import is_weekend, with_calendar_features
from frostline.operators.freeze_thaw import daily_ftc, windowed_ftc
from frostline.operators.timeseries import by_area, forward_sum, lagged_sum, lags
from frostline.operators.weather import daily_weather, lookback_sum
from frostline.schema import CALENDAR_FEATURES, DEFAULT_PARAMS, DOW_NAMES


def daily_master(counts: DataFrame, hourly: DataFrame) -> DataFrame:
    """(ward, date, count, daily_precip, daily_snow, daily_ftc, calendar features).

    ``counts`` is the zero-filled daily series (ward, date, y); all wards in one plan.
    """
    w = daily_weather(hourly).select(
        "ward", "date", F.col("precip_mm").alias("daily_precip"), F.col("snow_cm").alias("daily_snow"))
    cycles = daily_ftc(hourly).withColumnRenamed("ftc", "daily_ftc")
    joined = (
        counts.withColumnRenamed("y", "pothole_count")
        .join(w, ["ward", "date"], "left").join(cycles, ["ward", "date"], "left")
        .withColumn("daily_ftc", F.coalesce("daily_ftc", F.lit(0)))
    )
    return with_calendar_features(joined)


def assemble_features(master: DataFrame, params: dict | None = None) -> DataFrame:
    """Feature matrix of one parameter setting; rows with any null dropped."""
    p = {**DEFAULT_PARAMS, **(params or {})}
    w = by_area()
    return master.withColumns({
        "Y": forward_sum(F.col("pothole_count"), w, p["d"]),
        "precip_roll": lagged_sum(F.col("daily_precip"), w, p["d_p"], p["l_p"]),
        "snow_roll": lagged_sum(F.col("daily_snow"), w, p["d_s"], p["l_s"]),
        "ftc_roll": lagged_sum(F.col("daily_ftc"), w, p["d_f"], p["l_f"]),
        **lags("pothole_count", w, list(range(1, p["k_AR"] + 1)), prefix="pothole_lag"),
    }).drop("pothole_count", "daily_precip", "daily_snow", "daily_ftc").dropna()


def feature_columns(k_ar: int = DEFAULT_PARAMS["k_AR"]) -> list[str]:
    return ["precip_roll", "snow_roll", "ftc_roll",
            *[f"pothole_lag{i}" for i in range(1, k_ar + 1)], *CALENDAR_FEATURES]


MODEL_COLUMNS = [
    "pothole_count", "tmax_c", "tmin_c", "tmean_c", "precip_mm", "snow_cm",
    "t_range", "freeze_day", "freeze_thaw_day", "heavy_rain_day", "ftc_15d", "precip_15d",
    "day_of_year", "sin_doy", "cos_doy", "is_weekend", *[f"dow_{d}" for d in DOW_NAMES],
    "pothole_lag1", "pothole_lag7",
]

VIF_COLUMNS = [
    "tmax_c", "tmin_c", "tmean_c", "precip_mm", "snow_cm", "t_range", "ftc_15d", "precip_15d",
    "day_of_year", "sin_doy", "cos_doy", "pothole_lag1", "pothole_lag7",
]


def daily_features(counts: DataFrame, hourly: DataFrame, lookback_days: int = 15) -> DataFrame:
    """Daily counts with weather, flags, look-backs, calendar features and lags 1 and 7."""
    targets = counts.select("ward", "date")
    daily = daily_weather(hourly)
    merged = (
        counts.withColumnRenamed("y", "pothole_count")
        .join(daily, ["ward", "date"], "left")
        .join(windowed_ftc(hourly, targets, lookback_days), ["ward", "date"], "left")
        .join(lookback_sum(daily, targets, "precip_mm", "precip_15d", lookback_days), ["ward", "date"], "left")
    )
    w = by_area()
    return (
        with_calendar_features(weather_flags(merged))
        .withColumns({
            "day_of_year": F.dayofyear("date"), "is_weekend": is_weekend(F.col("date")),
            **lags("pothole_count", w, [1, 7], prefix="pothole_lag"),
        })
    )


def daily_model_table(counts: DataFrame, hourly: DataFrame) -> DataFrame:
    """The fixed column order of the daily model, rows with any null dropped."""
    return daily_features(counts, hourly).select("ward", "date", *MODEL_COLUMNS).dropna()
