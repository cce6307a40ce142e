"""Rollups of the request table: counts, lateness summaries, shares, entropies, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.dates import calendar_parts, is_weekend, month_text
from frostline.operators.quantiles import aggregate
from frostline.operators.topn import top_k, top_n_per_group
from frostline.runtime import ranked, scalars


def known(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return known(df, *keys).groupBy(*keys).agg(F.count("*").alias(name))


def counts_with_total(df: DataFrame, keys: list[str], name: str = "num_requests") -> DataFrame:
    """``counts`` plus the number of keys and the average count on every row."""
    c = counts(df, keys, name)
    s = c.agg(F.count("*").alias("n_keys"), F.avg(name).alias("avg_per_key"))
    return c.withColumn("_s", scalars(s)).select(*keys, name, "_s.n_keys", "_s.avg_per_key")


def shares(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Counts per key and their share of the total."""
    c = counts(df, [key], name)
    total = c.agg(F.sum(name).alias("t")).scalar()
    return c.withColumn("share", F.col(name) / total)


def top_values(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return top_k(counts(df, [key]), n, F.desc("n"), F.col(key))


def in_top_values(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` most frequent."""
    return df.join(top_values(df, key, n).select(key), key, "left_semi")


def lateness_summary(df: DataFrame, key: str, on_time: bool = False) -> DataFrame:
    """n, median and p90 response hours, overdue (and on-time) rate per key."""
    aggs = {"n": F.count("*"), "overdue_rate": F.avg("overdue")}
    if on_time:
        aggs["on_time_rate"] = F.avg("on_time")
    rt = F.col("response_hours")
    return aggregate(known(df, key), [key], aggs, {"median_rt": (rt, 0.5), "p90_rt": (rt, 0.9)})


def type_summary(df: DataFrame, top: int = 25) -> DataFrame:
    """The ``top`` most frequent services; their counts come with the summary, so rows are not read for them apart."""
    return top_k(lateness_summary(df, "service", on_time=True), top, F.desc("n"), F.col("service"))


def monthly_summary(df: DataFrame) -> DataFrame:
    """Volume, median response and overdue rate per month; undated rows form 'NaT'."""
    return aggregate(
        df.withColumn("month", month_text(F.col("add_ts"))), ["month"],
        {"n": F.count("*"), "overdue_rate": F.avg("overdue")},
        {"median_rt": (F.col("response_hours"), 0.5)},
    )


def overall_rates(df: DataFrame) -> DataFrame:
    """Overdue rate of all rows, on-time rate of rows with both durations."""
    return df.agg(
        F.count("*").alias("n"),
        F.sum("has_both").alias("n_both"),
        F.avg("overdue").alias("overdue_rate"),
        F.avg(F.when(F.col("has_both") == 1, F.col("on_time"))).alias("on_time_rate"),
    )


def weekday_counts(df: DataFrame, ts: str = "add_ts", zero_fill: bool = False) -> DataFrame:
    """Counts for all seven weekdays in order; a missing day is null, or 0 if filled."""
    c = counts(df.select(F.weekday(ts).alias("day_of_week")), ["day_of_week"])
    days = df.sparkSession.range(7).select(
        F.col("id").cast("int").alias("day_of_week"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "EEEE").alias("day_name"))
    out = days.join(c, "day_of_week", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))) if zero_fill else out


def mean_per_active(df: DataFrame, area: str, part: str) -> DataFrame:
    """Per (area, calendar part) counts with the area's total and mean per active part."""
    c = counts(df, [area, part])
    s = c.groupBy(area).agg(F.sum("n").alias("total"), F.avg("n").alias("mean_per_active"))
    return c.join(s, area)


def daily_count_stats(df: DataFrame, day: str) -> DataFrame:
    """Statistics of the counts per day, with the (lowest) busiest and quietest day."""
    c = counts(df, [day])
    return aggregate(
        c, [],
        {
            "n_days": F.count("*"), "mean": F.avg("n"), "std": F.stddev_samp("n"),
            "min": F.min("n"), "max": F.max("n"),
            "argmax_day": F.max_by(F.col(day), F.struct(F.col("n"), -F.col(day))),
            "argmin_day": F.min_by(F.col(day), F.struct(F.col("n"), F.col(day))),
        },
        {"median": (F.col("n"), 0.5)},
    )


# --- geography ----------------------------------------------------------------

def hotspots(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Counts on a rounded coordinate grid (half-even rounding)."""
    binned = known(df, "lat", "lon").select(
        F.bround("lat", decimals).alias("lat_bin"), F.bround("lon", decimals).alias("lon_bin"))
    return counts(binned, ["lat_bin", "lon_bin"])


def ward_geography(df: DataFrame) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return aggregate(
        known(df, "ward", "lat", "lon"), ["ward"],
        {"count": F.count("*"), "lat_min": F.min(lat), "lat_max": F.max(lat),
         "lon_min": F.min(lon), "lon_max": F.max(lon)},
        {"lat_median": (lat, 0.5), "lon_median": (lon, 0.5)},
    )


def ward_centroids(df: DataFrame) -> DataFrame:
    return known(df, "ward", "lat", "lon").groupBy("ward").agg(
        F.avg("lat").alias("avg_latitude"), F.avg("lon").alias("avg_longitude"))


def bounding_box(df: DataFrame, padding: float = 0.05) -> DataFrame:
    """Coordinate range with padding and the range of daily totals."""
    geo = known(df, "lat", "lon")
    per_day = counts(geo.select(F.dayofyear("add_ts").alias("doy")), ["doy"]).agg(
        F.min("n").alias("day_min"), F.max("n").alias("day_max"), F.count("*").alias("n_days"))
    box = geo.agg(
        F.count("*").alias("n"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    lat_pad = (F.col("lat_max") - F.col("lat_min")) * padding
    lon_pad = (F.col("lon_max") - F.col("lon_min")) * padding
    return box.withColumn("_s", scalars(per_day)).select(
        "n", (F.col("lat_min") - lat_pad).alias("lat_lo"), (F.col("lat_max") + lat_pad).alias("lat_hi"),
        (F.col("lon_min") - lon_pad).alias("lon_lo"), (F.col("lon_max") + lon_pad).alias("lon_hi"),
        "_s.day_min", "_s.day_max", "_s.n_days")


# --- distribution over categories ----------------------------------------------

def entropy_and_peak(df: DataFrame, key: str, part: str, entropy: str, peak: str) -> DataFrame:
    """Shannon entropy (natural log) and largest share of each key's distribution over ``part``."""
    return entropy_of_counts(counts(df, [key, part]), key, part, entropy, peak)


def entropy_of_counts(cells: DataFrame, key: str, part: str, entropy: str, peak: str) -> DataFrame:
    """The same from counts ``n`` by at least key and part; rows without either are left out."""
    c = known(cells, key, part).groupBy(key, part).agg(F.sum("n").alias("n"))
    total = c.groupBy(key).agg(F.sum("n").alias("t"), F.max("n").alias("m"),
                               F.sum(F.col("n") * F.ln("n")).alias("s"))
    # -sum(p ln p) with p = n/t equals ln t - sum(n ln n)/t, so one pass is enough.
    return total.select(key, (F.ln("t") - F.col("s") / F.col("t")).alias(entropy),
                        (F.col("m") / F.col("t")).alias(peak))


def entropy_from_counts(n: Column) -> Column:
    """The same as an aggregate expression over a column of counts."""
    t = F.sum(n)
    return F.ln(t) - F.sum(F.when(n > 0, n * F.ln(n))) / t


def type_features(df: DataFrame, min_support: int = 200) -> DataFrame:
    """One feature row per service type with at least ``min_support`` requests."""
    d = known(df, "service").withColumns({
        "month": month_text(F.col("add_ts")), "weekend": F.coalesce(is_weekend(F.to_date("add_ts")), F.lit(0))})
    rt = F.col("response_hours")
    core = aggregate(
        d, ["service"],
        {"n_requests": F.count("*"), "mean_rt": F.avg(rt), "std_rt": F.stddev_samp(rt),
         "overdue_rate": F.avg("overdue"), "weekend_share": F.avg("weekend")},
        {"median_rt": (rt, 0.5), "p90_rt": (rt, 0.9), "median_due": (F.col("due_hours"), 0.5),
         "median_late_all": (F.col("late_hours"), 0.5),
         "median_late_overdue": (F.when(F.col("overdue") == 1, F.col("late_hours")), 0.5)},
    ).where(F.col("n_requests") >= min_support)
    cells = d.groupBy("service", "month", "ward").agg(F.count("*").alias("n"))  # both distributions come from one pass
    months = entropy_of_counts(cells, "service", "month", "month_entropy", "peak_month_share")
    wards = entropy_of_counts(cells, "service", "ward", "ward_entropy", "top_ward_share")
    return (
        core.join(months, "service", "left").join(wards, "service", "left")
        .withColumn("rt_cv", F.try_divide("std_rt", "mean_rt"))
        .withColumn("log_n_requests", F.log1p(F.col("n_requests").cast("double")))
    )


def rare_share(df: DataFrame, key: str, at_most: int = 10) -> DataFrame:
    """Number of categories and the share of them with few rows."""
    c = counts(df, [key])
    return c.agg(F.count("*").alias("n_categories"), F.avg((F.col("n") <= at_most).cast("int")).alias("rare_share"))


def log1p_nonnegative(c: Column) -> Column:
    """log(1 + x) with negatives at 0; null stays null (``greatest`` alone would give 0)."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def histogram(df: DataFrame, value: Column, bins: int, density: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed, empty bins are 0."""
    v = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lim = scalars(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    c = (
        v.withColumn("_s", lim)
        .select(F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_s.lo")) / width), F.lit(bins - 1)))
                .otherwise(F.lit(0)).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    full = (
        df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(c, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_s", lim)
    )
    out = full.select("bin", (F.col("_s.lo") + F.col("bin") * width).alias("left_edge"), "n",
                      F.try_divide(F.col("n"), F.col("_s.n") * width).alias("density"))
    return out if density else out.drop("density")


def clip_at_quantile(df: DataFrame, value: str, p: float = 0.99) -> DataFrame:
    """Values above the p-quantile are set to it; nulls stay null."""
    cap = aggregate(df, [], {}, {"cap": (F.col(value), p)}).scalar()
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.col(value), cap)))


def first_seen_code(df: DataFrame, label: str, order: str) -> DataFrame:
    """Dense integer code of each label in order of first appearance (ties by label)."""
    first = known(df, label).groupBy(label).agg(F.min(order).alias("first"))
    return ranked(first, ["first", label], "code").select(label, F.col("code").cast("int").alias("code"))


def zero_filled_pivot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of key x column with the column's values spread out; absent pairs are 0."""
    return known(df, key).groupBy(key).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def week_by_weekday(df: DataFrame, ts: str = "add_ts") -> DataFrame:
    """Per ISO week seven weekday counts, the week's total and a common upper limit."""
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    d = df.select(F.weekofyear(ts).alias("week"), F.weekday(ts).alias("dow")).where(F.col("week").isNotNull())
    m = d.groupBy("week").agg(
        *[F.count_if(F.col("dow") == i).alias(n) for i, n in enumerate(names)], F.count("*").alias("total"))
    top = m.agg(F.max(F.greatest(*names)).alias("t")).scalar()
    return m.withColumn("y_max", top * F.lit(1.1))


def services_per_ward(df: DataFrame, n: int = 50) -> DataFrame:
    """Top services of every ward with their rank and the ward's number of services."""
    c = counts(df, ["ward", "service"])
    total = c.groupBy("ward").agg(F.count("*").alias("n_services"))
    return top_n_per_group(c, ["ward"], n, [F.desc("n"), F.col("service")], rank="rank").join(total, "ward")


def mean_response(df: DataFrame, lowest: int) -> DataFrame:
    """Services with the lowest mean response time."""
    m = known(df, "service").groupBy("service").agg(F.avg("response_hours").alias("mean_rt"))
    return top_k(m.where(F.col("mean_rt").isNotNull()), lowest, F.col("mean_rt"), F.col("service"))


def keyword_tags(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Services containing any keyword, tagged with the first that matches, with counts."""
    from frostline.functions.clean import first_keyword

    return (
        counts(df, ["service"])
        .withColumn("keyword", first_keyword(F.col("service"), keywords))
        .where(F.col("keyword").isNotNull())
    )


def dated(df: DataFrame, ts: str = "add_ts") -> DataFrame:
    """Rows with a known date, with all calendar parts as columns."""
    return known(df, ts).withColumns(calendar_parts(F.col(ts)))
