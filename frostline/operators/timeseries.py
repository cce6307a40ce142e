"""Calendars, zero-filled series, rolling frames and lags.

Every window is partitioned by area, so a partition holds at most one area's calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_area(area: str = "ward", order: str = "date") -> WindowSpec:
    return Window.partitionBy(area).orderBy(order)


def with_calendar(keys: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """One row per key row and day of the fixed calendar."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return keys.select("*", F.explode(days).alias(date))


def zero_filled_daily(counts: DataFrame, area: str, start: str, end: str, value: str) -> DataFrame:
    """Left join of every area's full calendar with its counts; absent days are 0.

    ``counts`` is already aggregated to (area, date), so the join moves at most
    areas x days rows.
    """
    grid = with_calendar(counts.select(area).distinct(), start, end)
    return (
        grid.join(counts, [area, "date"], "left")
        .withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    )


# --- frames: a frame is null unless every row in it holds a value -------------

def full_sum(c: Column, w: WindowSpec, first: int, last: int) -> Column:
    f = w.rowsBetween(first, last)
    return F.when(F.count(c).over(f) == last - first + 1, F.sum(c).over(f))


def full_mean(c: Column, w: WindowSpec, first: int, last: int) -> Column:
    f = w.rowsBetween(first, last)
    return F.when(F.count(c).over(f) == last - first + 1, F.avg(c).over(f))


def forward_sum(c: Column, w: WindowSpec, d: int) -> Column:
    """Rows t+1 .. t+d."""
    return full_sum(c, w, 1, d)


def forward_sum_inclusive(c: Column, w: WindowSpec, d: int) -> Column:
    """Rows t .. t+d."""
    if d < 0:
        raise ValueError("d must be >= 0")
    return full_sum(c, w, 0, d)


def lagged_sum(c: Column, w: WindowSpec, width: int, shift: int) -> Column:
    """Rows t-shift-width+1 .. t-shift."""
    return full_sum(c, w, -(shift + width - 1), -shift)


def centered_mean(c: Column, w: WindowSpec, width: int = 15) -> Column:
    half = width // 2
    return full_mean(c, w, -half, width - 1 - half)


def trailing_mean(c: Column, w: WindowSpec, k: int) -> Column:
    """Mean of the k rows before the current one."""
    return full_mean(c, w, -k, -1)


def lags(name: str, w: WindowSpec, steps: list[int], prefix: str | None = None) -> dict[str, Column]:
    return {f"{prefix or name + '_lag'}{k}": F.lag(name, k).over(w) for k in steps}


def sequences(df: DataFrame, value: str, length: int, area: str = "ward", order: str = "date") -> DataFrame:
    """Rows t-length .. t-1 as an array, for rows with a full history."""
    f = by_area(area, order).rowsBetween(-length, -1)
    return df.withColumn("seq", F.collect_list(value).over(f)).where(F.size("seq") == length)
