"""Calendar parts, Fourier terms and weekday dummies as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.schema import DOW_NAMES


def week_start(date: Column) -> Column:
    """Monday of the week."""
    return F.trunc(date, "week")


def month_text(ts: Column) -> Column:
    """'yyyy-MM'; unknown dates form their own 'NaT' bucket."""
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("NaT"))


def is_weekend(date: Column) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def calendar_parts(ts: Column) -> dict[str, Column]:
    d = F.to_date(ts)
    return {
        "date": d,
        "year": F.year(d),
        "month": F.month(d),
        "iso_week": F.weekofyear(d),
        "day_of_year": F.dayofyear(d),
        "day_of_week": F.weekday(d),
        "day_name": F.date_format(d, "EEEE"),
        "quarter": F.quarter(d),
        "month_text": month_text(ts),
        "week_start": week_start(d),
        "month_start": F.trunc(d, "month"),
    }


def fourier(position: Column, period: float, suffix: str) -> dict[str, Column]:
    angle = F.lit(2 * math.pi) * position / F.lit(float(period))
    return {f"sin_{suffix}": F.sin(angle), f"cos_{suffix}": F.cos(angle)}


def dow_dummies(date: Column) -> dict[str, Column]:
    """Six 0/1 columns, Sunday as the reference level."""
    return {f"dow_{name}": (F.weekday(date) == i).cast("int") for i, name in enumerate(DOW_NAMES)}


def with_calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Fourier day-of-year terms, weekend flag and weekday dummies."""
    d = F.col(date)
    return df.withColumns({
        **fourier(F.dayofyear(d), 365, "doy"),
        "is_weekend": is_weekend(d),
        **dow_dummies(d),
    })
