"""Ward x week panel: zero-filled grid, weather merge, imputation, lags and season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.clean import null_text_wards, valid_ward
from frostline.functions.dates import fourier, week_start
from frostline.operators.quantiles import aggregate
from frostline.operators.timeseries import by_area, lags, trailing_mean
from frostline.operators.weather import WEEKLY_COLUMNS
from frostline.runtime import materialize, scalars


def weekly_panel(requests: DataFrame, flag: Column) -> DataFrame:
    """(ward, week, y): every known ward of the table x every week of the flagged rows.

    The requests are reduced once to stored (ward, week) counts; wards, week limits and the
    counts all come from that small table, so the requests are scanned a single time. The
    grid is an exploded sequence per ward.
    """
    per_week = materialize(
        requests.select(null_text_wards(F.col("ward")).alias("ward"), week_start(F.to_date("add_ts")).alias("week"),
                        flag.alias("flag"))
        .groupBy("ward", "week").agg(F.count_if("flag").alias("y")),
        "ward-weeks")
    hits = per_week.where((F.col("y") > 0) & F.col("week").isNotNull())
    span = scalars(hits.agg(F.min("week").alias("lo"), F.max("week").alias("hi")))
    grid = (
        per_week.select("ward").dropna().distinct().withColumn("_s", span)
        .select("ward", F.explode(F.expr("sequence(_s.lo, _s.hi, interval 7 days)")).alias("week"))
    )
    return grid.join(hits.dropna(), ["ward", "week"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def with_weekly_weather(panel: DataFrame, weekly: DataFrame) -> DataFrame:
    return panel.join(weekly, ["ward", "week"], "left")


def impute(df: DataFrame, columns: list[str], area: str = "ward") -> DataFrame:
    """Null -> area median, then null -> median of the column so filled."""
    inner = aggregate(df, [area], {}, {f"m_{c}": (F.col(c), 0.5) for c in columns})
    filled = df.join(inner, area, "left").withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) for c in columns}
    ).drop(*[f"m_{c}" for c in columns])
    overall = aggregate(filled, [], {}, {c: (F.col(c), 0.5) for c in columns})
    return filled.withColumn("_s", scalars(overall)).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_s.{c}")) for c in columns}).drop("_s")


def panel_features(panel: DataFrame, weather: list[str] | None = None) -> DataFrame:
    """Target lags and trailing means, weather lag 1, week-of-year season; null rows dropped."""
    weather = weather or WEEKLY_COLUMNS
    w = by_area("ward", "week")
    woy = F.weekofyear("week")
    return panel.withColumns({
        **lags("y", w, [1, 2, 4, 8]),
        "y_roll4": trailing_mean(F.col("y"), w, 4),
        "y_roll8": trailing_mean(F.col("y"), w, 8),
        **{f"{c}_lag1": F.lag(c).over(w) for c in weather},
        "weekofyear": woy,
        "month": F.month("week"),
        **fourier(woy, 52, "woy"),
    }).dropna()


def weekly_model_table(panel_weather: DataFrame) -> DataFrame:
    """Imputed panel of the regular wards with all model features."""
    ready = impute(panel_weather, WEEKLY_COLUMNS).where(valid_ward(F.col("ward")))
    return panel_features(ready)


def panel_feature_columns(weather: list[str] | None = None) -> list[str]:
    weather = weather or WEEKLY_COLUMNS
    return [*weather, "y_lag1", "y_lag2", "y_lag4", "y_lag8", "y_roll4", "y_roll8",
            *[f"{c}_lag1" for c in weather], "weekofyear", "month", "sin_woy", "cos_woy"]


def ordered_weeks(df: DataFrame, week: str = "week"):
    """All distinct weeks in order as one array (its length is bounded by the calendar)."""
    return df.where(F.col(week).isNotNull()).select(week).distinct().agg(
        F.sort_array(F.collect_list(week)).alias("w")).scalar()


def time_split(df: DataFrame, test_horizon: int = 8, valid_horizon: int = 8) -> DataFrame:
    """train / valid / test by week: last weeks test, the ones before validation."""
    weeks = ordered_weeks(df)
    need = test_horizon + valid_horizon
    checked = F.when(F.size("_w") <= need, F.raise_error(F.lit("not enough weeks for this split")).cast("date"))
    return (
        df.withColumn("_w", weeks)
        .withColumn("_valid", F.coalesce(checked, F.element_at("_w", F.lit(-need))))
        .withColumn("split", F.when(F.col("week") < F.col("_valid"), "train")
                    .when(F.col("week") < F.element_at("_w", F.lit(-test_horizon)), "valid").otherwise("test"))
        .drop("_w", "_valid")
    )


def expanding_folds(weeks_of: DataFrame, train_min: int = 24, horizon: int = 8, step: int = 4) -> DataFrame:
    """One row per (fold, week, role): train on weeks before the cut-off, validate on the next ones.

    Built by exploding the ordered week array – no non-equi join.
    """
    one = weeks_of.sparkSession.range(1).select(ordered_weeks(weeks_of).alias("w"))
    last = F.size("w") - horizon
    cut = one.withColumn("cutoff", F.explode(
        F.when(last >= train_min, F.sequence(F.lit(train_min), last, F.lit(step))).otherwise(F.array().cast("array<int>"))))
    return (
        cut.withColumn("fold", ((F.col("cutoff") - train_min) / step).cast("int") + 1)
        .select("fold", "cutoff", F.posexplode("w").alias("idx", "week"))
        .where(F.col("idx") < F.col("cutoff") + horizon)
        .select("fold", "week", F.when(F.col("idx") < F.col("cutoff"), "train").otherwise("valid").alias("role"))
    )


def with_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows repeated for every fold they take part in (equi-join on week)."""
    return df.join(folds, "week")
