"""Queries on calendars, weather, freeze-thaw cycles, panels, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.catalog.registry import query, rounded
from frostline.catalog.roles import (
    FLAG_WORD, SERIES_END, SERIES_START, daily_counts, events_hourly, long_hourly, requests, table, ward_orders)
from frostline.catalog.sql import block
from frostline.functions.clean import contains_ci, weather_flags, word_ci
from frostline.operators import encoding, freeze_thaw as ft, panel as pn, splits as sp, timeseries as ts, weather as we
from frostline.operators.rollups import in_top_values
from frostline.plans import daily as pd_
from frostline.runtime import materialize, scratch_path
from frostline.schema import DEFAULT_PARAMS, PARAM_GRID
from frostline.sources import requests as src
from frostline.sources import weather as wsrc

WIDGET = "red widget"

# --- shared SQL blocks ---------------------------------------------------------------

block("daily_long", """
SELECT w.ward, CAST(w.d AS DATE) AS date, x.tmax_c, x.tmin_c, x.tmean_c, coalesce(x.p, 0) AS precip_mm, coalesce(x.s, 0) AS snow_cm
FROM (SELECT ward, unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM (
    SELECT ward, date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP AS hi FROM long_hourly GROUP BY ward) q) w
LEFT JOIN (SELECT ward, CAST(ts AS DATE) AS date, max(temperature_2m) AS tmax_c, min(temperature_2m) AS tmin_c,
    avg(temperature_2m) AS tmean_c, sum(precipitation) AS p, sum(snowfall) AS s FROM long_hourly GROUP BY 1, 2) x
  ON x.ward = w.ward AND x.date = CAST(w.d AS DATE)
""", "long_hourly")


def _daily_from(src_: str) -> str:
    return f"""
SELECT w.ward, CAST(w.d AS DATE) AS date, x.tmax_c, x.tmin_c, x.tmean_c, coalesce(x.p, 0) AS precip_mm, coalesce(x.s, 0) AS snow_cm
FROM (SELECT ward, unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM (
    SELECT ward, date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP AS hi FROM {src_} GROUP BY ward) q) w
LEFT JOIN (SELECT ward, CAST(ts AS DATE) AS date, max(temperature_2m) AS tmax_c, min(temperature_2m) AS tmin_c,
    avg(temperature_2m) AS tmean_c, sum(precipitation) AS p, sum(snowfall) AS s FROM {src_} GROUP BY 1, 2) x
  ON x.ward = w.ward AND x.date = CAST(w.d AS DATE)"""


block("daily_events", _daily_from("events_hourly"), "events_hourly")


def _runs(src_: str) -> str:
    return f"""
SELECT ward, ts, label, rn - row_number() OVER (PARTITION BY ward, label ORDER BY ts) AS isl, rn
FROM (SELECT ward, ts, row_number() OVER (PARTITION BY ward ORDER BY ts) AS rn,
  CASE WHEN temperature_2m < 0 THEN 'F' WHEN temperature_2m > 4 THEN 'T' ELSE 'N' END AS label FROM {src_}) a"""


def _ftc(runs: str) -> str:
    return f"""
SELECT ward, CAST(e AS DATE) AS date, count(*) AS ftc FROM (
  SELECT ward, label, e, lag(label) OVER (PARTITION BY ward ORDER BY e) AS before FROM (
    SELECT ward, label, isl, max(ts) AS e, count(*) AS hours FROM {runs} GROUP BY 1, 2, 3) r
  WHERE label <> 'N' AND hours >= 4) q
WHERE label = 'T' AND before = 'F' GROUP BY 1, 2"""


def _ftc_window(runs: str, targets: str) -> str:
    return f"""
SELECT t.ward, t.date, CAST(coalesce(c.ftc_15d, 0) AS BIGINT) AS ftc_15d FROM {targets} t LEFT JOIN (
  SELECT ward, date, count(*) FILTER (WHERE label = 'T' AND before = 'F') AS ftc_15d FROM (
    SELECT ward, date, label, lag(label) OVER (PARTITION BY ward, date ORDER BY s) AS before FROM (
      SELECT r.ward, g.date, r.label, r.isl, min(r.ts) AS s, count(*) AS hours FROM {runs} r
      JOIN {targets} g ON g.ward = r.ward AND r.ts >= CAST(g.date AS TIMESTAMP) - INTERVAL 15 DAY AND r.ts < CAST(g.date AS TIMESTAMP)
      WHERE r.label <> 'N' GROUP BY 1, 2, 3, 4) a WHERE hours >= 4) b GROUP BY 1, 2) c
ON c.ward = t.ward AND c.date = t.date"""


def _rain(daily: str, targets: str) -> str:
    return f"""
SELECT t.ward, t.date, coalesce(sum(d.precip_mm), 0) AS precip_15d FROM {targets} t LEFT JOIN {daily} d
  ON d.ward = t.ward AND d.date >= t.date - 15 AND d.date < t.date GROUP BY 1, 2"""


block("runs_long", _runs("long_hourly"), "long_hourly")
block("runs_events", _runs("events_hourly"), "events_hourly")
block("ftc_long", _ftc("runs_long"), "runs_long")
block("ftc_events", _ftc("runs_events"), "runs_events")
block("ftcw_daily", _ftc_window("runs_long", "daily_long"), "runs_long", "daily_long")
block("ftcw_events", _ftc_window("runs_events", "daily_events"), "runs_events", "daily_events")
block("rain_daily", _rain("daily_long", "daily_long"), "daily_long")
block("rain_events", _rain("daily_events", "daily_events"), "daily_events")

_FLAGS = """tmax_c - tmin_c AS t_range, CASE WHEN tmin_c < 0 THEN 1 ELSE 0 END AS freeze_day,
  CASE WHEN tmin_c < 0 AND tmax_c > 0 THEN 1 ELSE 0 END AS freeze_thaw_day, CASE WHEN precip_mm >= 10 THEN 1 ELSE 0 END AS heavy_rain_day"""

block("enriched", f"""
SELECT d.*, {_FLAGS}, f.ftc_15d, r.precip_15d FROM daily_long d
JOIN ftcw_daily f ON f.ward = d.ward AND f.date = d.date JOIN rain_daily r ON r.ward = d.ward AND r.date = d.date
""", "daily_long", "ftcw_daily", "rain_daily")

block("weekly", """
SELECT ward, CAST(date_trunc('week', date) AS DATE) AS week, sum(precip_mm) AS precip_mm_sum, sum(snow_cm) AS snow_cm_sum,
  avg(tmax_c) AS tmax_c_mean, avg(tmin_c) AS tmin_c_mean, avg(tmean_c) AS tmean_c_mean, avg(t_range) AS t_range_mean,
  CAST(sum(freeze_day) AS BIGINT) AS freeze_days, CAST(sum(freeze_thaw_day) AS BIGINT) AS freeze_thaw_days,
  CAST(sum(heavy_rain_day) AS BIGINT) AS heavy_rain_days, avg(ftc_15d) AS ftc_15d_mean, max(ftc_15d) AS ftc_15d_max, avg(precip_15d) AS precip_15d_mean
FROM enriched GROUP BY 1, 2
""", "enriched")

block("panel_y", """
SELECT ward, CAST(date_trunc('week', add_ts) AS DATE) AS week, count(*) AS y FROM requests
WHERE regexp_matches(service, '(?i)\\bwidget(s)?\\b') AND ward IS NOT NULL AND add_ts IS NOT NULL GROUP BY 1, 2
""", "requests")
block("panel_span", """
SELECT date_trunc('week', min(add_ts))::TIMESTAMP AS lo, date_trunc('week', max(add_ts))::TIMESTAMP AS hi FROM requests
WHERE regexp_matches(service, '(?i)\\bwidget(s)?\\b')
""", "requests")
block("panel", """
SELECT w.ward, CAST(k.d AS DATE) AS week, coalesce(p.y, 0) AS y FROM (SELECT DISTINCT ward FROM requests WHERE ward IS NOT NULL) w
CROSS JOIN (SELECT unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS d FROM panel_span) k
LEFT JOIN panel_y p ON p.ward = w.ward AND p.week = CAST(k.d AS DATE)
""", "requests", "panel_span", "panel_y")
block("panel_w", "SELECT p.*, w.* EXCLUDE (ward, week) FROM panel p LEFT JOIN weekly w ON w.ward = p.ward AND w.week = p.week",
      "panel", "weekly")

_WC = we.WEEKLY_COLUMNS
block("imp1", "SELECT ward, week, y, " + ", ".join(
    f"coalesce({c}, median({c}) OVER (PARTITION BY ward)) AS {c}" for c in _WC) + " FROM panel_w", "panel_w")
block("imp_med", "SELECT " + ", ".join(f"median({c}) AS {c}" for c in _WC) + " FROM imp1", "imp1")
block("imputed", "SELECT i.ward, i.week, i.y, " + ", ".join(f"coalesce(i.{c}, m.{c}) AS {c}" for c in _WC)
      + " FROM imp1 i CROSS JOIN imp_med m", "imp1", "imp_med")
block("lagged", "SELECT *, " + ", ".join(f"lag(y, {k}) OVER w AS y_lag{k}" for k in (1, 2, 4, 8)) + """,
  CASE WHEN count(y) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4 THEN avg(y) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS y_roll4,
  CASE WHEN count(y) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 8 THEN avg(y) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END AS y_roll8, """
      + ", ".join(f"lag({c}) OVER w AS {c}_lag1" for c in _WC)
      + ", date_part('week', week) AS weekofyear, date_part('month', week) AS month, sin(2 * pi() * date_part('week', week) / 52) AS sin_woy, cos(2 * pi() * date_part('week', week) / 52) AS cos_woy"
      + " FROM imputed WHERE regexp_matches(ward, '^Ward\\s+[1-8]$') WINDOW w AS (PARTITION BY ward ORDER BY week)", "imputed")
_MODEL_COLS = pn.panel_feature_columns()
block("weekly_model", "SELECT ward, week, y, " + ", ".join(_MODEL_COLS) + " FROM lagged WHERE "
      + " AND ".join(f"{c} IS NOT NULL" for c in _MODEL_COLS), "lagged")

_CAL = ("CASE WHEN abs(sin(2 * pi() * date_part('doy', {d}) / 365)) < 1e-12 THEN 0 ELSE sin(2 * pi() * date_part('doy', {d}) / 365) END AS sin_doy, "
        "cos(2 * pi() * date_part('doy', {d}) / 365) AS cos_doy, CAST(date_part('isodow', {d}) >= 6 AS BIGINT) AS is_weekend, "
        + ", ".join(f"CAST(date_part('isodow', {{d}}) = {i + 1} AS BIGINT) AS dow_{n}"
                    for i, n in enumerate(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"])))

block("master", f"""
SELECT c.ward, c.date, c.y AS pothole_count, w.precip_mm AS daily_precip, w.snow_cm AS daily_snow,
  CAST(coalesce(f.ftc, 0) AS BIGINT) AS daily_ftc, {_CAL.format(d='c.date')}
FROM daily_counts c LEFT JOIN daily_long w ON w.ward = c.ward AND w.date = c.date
LEFT JOIN ftc_long f ON f.ward = c.ward AND f.date = c.date
""", "daily_counts", "daily_long", "ftc_long")


def _full(expr: str, first: str, last: str, n: int, f: str = "sum") -> str:
    frame = f"(w ROWS BETWEEN {first} AND {last})"
    return f"CASE WHEN count({expr}) OVER {frame} = {n} THEN {f}({expr}) OVER {frame} END"


def _roll(expr: str, width: int, shift: int) -> str:
    last = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    return _full(expr, f"{width + shift - 1} PRECEDING", last, width)


_P = DEFAULT_PARAMS
_FEATS = pd_.feature_columns()
block("features_all", f"""
SELECT ward, date, {_full('pothole_count', '1 FOLLOWING', f"{_P['d']} FOLLOWING", _P['d'])} AS Y,
  {_roll('daily_precip', _P['d_p'], _P['l_p'])} AS precip_roll, {_roll('daily_snow', _P['d_s'], _P['l_s'])} AS snow_roll,
  {_roll('daily_ftc', _P['d_f'], _P['l_f'])} AS ftc_roll,
  {', '.join(f'lag(pothole_count, {k}) OVER w AS pothole_lag{k}' for k in range(1, _P['k_AR'] + 1))},
  sin_doy, cos_doy, is_weekend, dow_Mon, dow_Tue, dow_Wed, dow_Thu, dow_Fri, dow_Sat
FROM master WINDOW w AS (PARTITION BY ward ORDER BY date)
""", "master")
block("features", "SELECT * FROM features_all WHERE Y IS NOT NULL AND "
      + " AND ".join(f"{c} IS NOT NULL" for c in _FEATS), "features_all")

block("ftcw_counts", _ftc_window("runs_long", "daily_counts"), "runs_long", "daily_counts")
block("rain_counts", _rain("daily_long", "daily_counts"), "daily_long", "daily_counts")
block("daily_feats", f"""
SELECT c.ward, c.date, c.y AS pothole_count, w.tmax_c, w.tmin_c, w.tmean_c, w.precip_mm, w.snow_cm, {_FLAGS}, f.ftc_15d, r.precip_15d,
  date_part('doy', c.date) AS day_of_year, {_CAL.format(d='c.date')},
  lag(c.y, 1) OVER (PARTITION BY c.ward ORDER BY c.date) AS pothole_lag1, lag(c.y, 7) OVER (PARTITION BY c.ward ORDER BY c.date) AS pothole_lag7
FROM daily_counts c LEFT JOIN daily_long w ON w.ward = c.ward AND w.date = c.date
LEFT JOIN ftcw_counts f ON f.ward = c.ward AND f.date = c.date LEFT JOIN rain_counts r ON r.ward = c.ward AND r.date = c.date
""", "daily_counts", "daily_long", "ftcw_counts", "rain_counts")
block("daily_model", "SELECT ward, date, " + ", ".join(pd_.MODEL_COLUMNS) + " FROM daily_feats WHERE "
      + " AND ".join(f"{c} IS NOT NULL" for c in pd_.MODEL_COLUMNS), "daily_feats")

block("ranked_days", """
SELECT date, date_part('quarter', date) AS quarter, row_number() OVER (PARTITION BY date_part('quarter', date)
    ORDER BY md5('42:' || strftime(date, '%Y-%m-%d')), date) AS r, count(*) OVER (PARTITION BY date_part('quarter', date)) AS n FROM calendar
""", "calendar")
block("split_days", """
SELECT date, quarter, CASE WHEN r <= floor(n * CAST(0.15 AS DOUBLE) + 0.5) THEN 'test'
  WHEN r <= floor(n * CAST(0.15 AS DOUBLE) + 0.5) + floor(n * CAST(0.15 AS DOUBLE) + 0.5) THEN 'val' ELSE 'train' END AS split FROM ranked_days
""", "ranked_days")
block("weeks", "SELECT week, row_number() OVER (ORDER BY week) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM panel) t", "panel")


def cols(names, special=(), digits=6) -> str:
    """Select list with doubles rounded; a value that rounds to zero is plain zero."""
    return ", ".join(n if n in special else f"coalesce(nullif(round({n}, {digits}), 0), CASE WHEN {n} IS NOT NULL THEN 0.0 END) AS {n}" for n in names)


# --- inputs of the queries -----------------------------------------------------------

def panel(spark, sf):
    return pn.weekly_panel(requests(spark, sf, "service", "ward"), word_ci(F.col("service"), FLAG_WORD))


def weekly(spark, sf):
    return we.weekly_weather(we.enriched_daily(long_hourly(spark, sf)))


def panel_weather(spark, sf):
    """Stored once: imputation and modelling read it several times."""
    return materialize(pn.with_weekly_weather(panel(spark, sf), weekly(spark, sf)), "panel")


def weekly_model(spark, sf):
    return pn.weekly_model_table(panel_weather(spark, sf))


def master(spark, sf):
    return pd_.daily_master(daily_counts(spark, sf), long_hourly(spark, sf))


def features(spark, sf):
    return pd_.assemble_features(master(spark, sf))


def daily_model(spark, sf):
    return pd_.daily_model_table(daily_counts(spark, sf), long_hourly(spark, sf))


def calendar(spark):
    return ts.with_calendar(spark.range(1).select(), SERIES_START, SERIES_END)


# --- hourly source --------------------------------------------------------------------

@query("s2_scan_hourly", """
SELECT fmt, ward, count(*) AS n, count(temperature_2m) AS n_temp, round(sum(precipitation), 4) AS precip, round(max(temperature_2m), 3) AS tmax
FROM events_hourly CROSS JOIN (VALUES ('csv'), ('parquet')) v(fmt) GROUP BY 1, 2""", "events_hourly")
def s2(spark, sf):
    h = events_hourly(spark, sf)
    base = scratch_path(spark, "hourly")
    out = h.select("ward", F.col("ts").alias("date"), "temperature_2m", "precipitation", "snowfall")
    out.write.partitionBy("ward").option("header", True).csv(f"{base}/csv")
    out.write.partitionBy("ward").parquet(f"{base}/hours.parquet")
    frames = [wsrc.read_hourly(spark, p).withColumn("fmt", F.lit(f)) for f, p in
              (("csv", f"{base}/csv"), ("parquet", f"{base}/hours.parquet"))]
    return rounded(src.union_years(frames).groupBy("fmt", "ward").agg(
        F.count("*").alias("n"), F.count("temperature_2m").alias("n_temp"),
        F.round(F.sum("precipitation"), 4).alias("precip"), F.max("temperature_2m").alias("tmax")), 4)


# --- joins ----------------------------------------------------------------------------

@query("j1_zero_filled_daily", f"""
SELECT w.ward, c.date, coalesce(n.y, 0) AS y FROM (SELECT DISTINCT ward FROM requests WHERE service = '{WIDGET}' AND ward IS NOT NULL) w
CROSS JOIN calendar c LEFT JOIN (SELECT ward, CAST(add_ts AS DATE) AS date, count(*) AS y FROM requests
  WHERE service = '{WIDGET}' AND ward IS NOT NULL GROUP BY 1, 2) n ON n.ward = w.ward AND n.date = c.date""", "requests", "calendar")
def j1(spark, sf):
    return src.daily_request_counts(requests(spark, sf, "service", "ward"), WIDGET, SERIES_START, SERIES_END)


@query("j2_daily_merge", f"""
SELECT c.ward, c.date, c.y, {cols(['w.precip_mm', 'w.snow_cm']).replace('AS w.precip_mm', 'AS daily_precip').replace('AS w.snow_cm', 'AS daily_snow')}
FROM daily_counts c LEFT JOIN daily_long w ON w.ward = c.ward AND w.date = c.date""", "daily_counts", "daily_long")
def j2(spark, sf):
    w = we.daily_weather(long_hourly(spark, sf)).select(
        "ward", "date", F.col("precip_mm").alias("daily_precip"), F.col("snow_cm").alias("daily_snow"))
    return rounded(daily_counts(spark, sf).join(w, ["ward", "date"], "left"))


@query("j4_panel_grid", "SELECT ward, week, y FROM panel", "panel")
def j4(spark, sf):
    return panel(spark, sf)


_PW_SPECIAL = ("freeze_days", "freeze_thaw_days", "heavy_rain_days", "ftc_15d_max")


@query("j5_panel_weather", f"SELECT ward, week, y, {cols(_WC, _PW_SPECIAL)} FROM panel_w", "panel_w")
def j5(spark, sf):
    return rounded(pn.with_weekly_weather(panel(spark, sf), weekly(spark, sf)))


@query("j7_lookback_precip", "SELECT ward, date, round(precip_15d, 6) AS precip_15d FROM rain_events", "rain_events")
def j7(spark, sf):
    d = we.daily_weather(events_hourly(spark, sf))
    return rounded(we.lookback_sum(d, d.select("ward", "date"), "precip_mm", "precip_15d", 15))


@query("j8_param_grid", f"""
SELECT ward, d, d_p, l_p, d_s, l_s, d_f, l_f, "k_AR" FROM (SELECT DISTINCT ward FROM ward_orders WHERE ward IS NOT NULL) w
{' '.join(f'CROSS JOIN (SELECT CAST(unnest({v}) AS BIGINT) AS "{k}") t_{k}' for k, v in PARAM_GRID.items())}""", "ward_orders")
def j8(spark, sf):
    from frostline.models.sweep import param_grid

    wards = ward_orders(spark, sf).where(F.col("ward").isNotNull()).select("ward").distinct()
    return rounded(param_grid(wards, PARAM_GRID))


@query("j10_expanding_folds", """
SELECT f.fold, f.role, w.week, count(*) AS n, CAST(sum(p.y) AS BIGINT) AS y FROM (
  SELECT CAST((c - 24) / 4 + 1 AS BIGINT) AS fold, c, role FROM (SELECT unnest(range(24, CAST((SELECT max(n) FROM weeks) AS BIGINT) - 8 + 1, 4)) AS c) a
  CROSS JOIN (VALUES ('train'), ('valid')) r(role)) f
JOIN weeks w ON (f.role = 'train' AND w.idx < f.c) OR (f.role = 'valid' AND w.idx >= f.c AND w.idx < f.c + 8)
JOIN panel p ON p.week = w.week GROUP BY 1, 2, 3""", "weeks", "panel")
def j10(spark, sf):
    p = panel(spark, sf)
    per_week = p.groupBy("week").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    return rounded(pn.with_folds(per_week, pn.expanding_folds(p)).select("fold", "role", "week", "n", "y"))


# --- weather ----------------------------------------------------------------------------

_DW = ["tmax_c", "tmin_c", "tmean_c", "precip_mm", "snow_cm"]


@query("w1_daily_weather", f"SELECT ward, date, {cols(_DW, digits=8)} FROM daily_events WHERE date >= DATE '2024-01-02'", "daily_events")
def w1(spark, sf):
    return rounded(we.daily_weather(events_hourly(spark, sf)).where(F.col("date") >= F.lit("2024-01-02").cast("date")), 8)


@query("c20_weather_flags", f"""
SELECT ward, date, {cols(['t_range'])}, CAST(freeze_day AS BIGINT) AS freeze_day, CAST(freeze_thaw_day AS BIGINT) AS freeze_thaw_day,
  CAST(heavy_rain_day AS BIGINT) AS heavy_rain_day FROM (SELECT *, {_FLAGS} FROM daily_events) t""", "daily_events")
def c20(spark, sf):
    d = weather_flags(we.daily_weather(events_hourly(spark, sf)))
    return rounded(d.select("ward", "date", "t_range", "freeze_day", "freeze_thaw_day", "heavy_rain_day"))


@query("w2_weekly_weather", f"SELECT ward, week, {cols(_WC, _PW_SPECIAL)} FROM weekly", "weekly")
def w2(spark, sf):
    return rounded(weekly(spark, sf))


@query("w7_daily_ftc", """SELECT 'events' AS src, ward, date, ftc FROM ftc_events UNION ALL SELECT 'long', ward, date, ftc FROM ftc_long""",
       "ftc_events", "ftc_long")
def w7(spark, sf):
    a = ft.daily_ftc(events_hourly(spark, sf)).select(F.lit("events").alias("src"), "ward", "date", "ftc")
    b = ft.daily_ftc(long_hourly(spark, sf)).select(F.lit("long").alias("src"), "ward", "date", "ftc")
    return a.unionByName(b)


@query("w8_ftc_15d", """SELECT 'events' AS src, ward, date, ftc_15d FROM ftcw_events UNION ALL SELECT 'long', ward, date, ftc_15d FROM ftcw_daily""",
       "ftcw_events", "ftcw_daily")
def w8(spark, sf):
    out = []
    for name, h in (("events", events_hourly(spark, sf)), ("long", long_hourly(spark, sf))):
        targets = we.daily_weather(h).select("ward", "date")
        out.append(ft.windowed_ftc(h, targets).select(F.lit(name).alias("src"), "ward", "date", "ftc_15d"))
    return out[0].unionByName(out[1])


@query("f11_active_days", """
SELECT c.ward, count(*) FILTER (WHERE c.y = 0) AS zero_days, count(*) FILTER (WHERE f.ftc > 0) AS ftc_days, CAST(sum(c.y) AS BIGINT) AS total
FROM daily_counts c LEFT JOIN ftc_long f ON f.ward = c.ward AND f.date = c.date GROUP BY c.ward""", "daily_counts", "ftc_long")
def f11(spark, sf):
    f = ft.daily_ftc(long_hourly(spark, sf))
    return daily_counts(spark, sf).join(f, ["ward", "date"], "left").groupBy("ward").agg(
        F.count_if(F.col("y") == 0).alias("zero_days"), F.count_if(F.col("ftc") > 0).alias("ftc_days"),
        F.sum("y").alias("total"))


# --- rolling frames and lags ---------------------------------------------------------------

_W = " FROM daily_counts WINDOW w AS (PARTITION BY ward ORDER BY date)"


def _win(spark, sf, **exprs):
    return rounded(daily_counts(spark, sf).select("ward", "date", *[c.alias(n) for n, c in exprs.items()]))


def _int(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


@query("w3_forward_target", f"SELECT ward, date, {_int(_full('y', '1 FOLLOWING', '7 FOLLOWING', 7))} AS target{_W}", "daily_counts")
def w3(spark, sf):
    return _win(spark, sf, target=ts.forward_sum(F.col("y"), ts.by_area(), 7))


@query("w4_forward_inclusive", f"SELECT ward, date, {_int(_full('y', 'CURRENT ROW', '10 FOLLOWING', 11))} AS target{_W}", "daily_counts")
def w4(spark, sf):
    return _win(spark, sf, target=ts.forward_sum_inclusive(F.col("y"), ts.by_area(), 10))


@query("w5_lagged_roll", f"""
SELECT ward, date, {cols(['precip_roll', 'snow_roll'])}, CAST(ftc_roll AS BIGINT) AS ftc_roll FROM features_all""", "features_all")
def w5(spark, sf):
    w, p = ts.by_area(), DEFAULT_PARAMS
    return rounded(master(spark, sf).select(
        "ward", "date",
        ts.lagged_sum(F.col("daily_precip"), w, p["d_p"], p["l_p"]).alias("precip_roll"),
        ts.lagged_sum(F.col("daily_snow"), w, p["d_s"], p["l_s"]).alias("snow_roll"),
        ts.lagged_sum(F.col("daily_ftc"), w, p["d_f"], p["l_f"]).alias("ftc_roll")))


@query("w6_centered_mean", f"SELECT ward, date, round({_full('y', '7 PRECEDING', '7 FOLLOWING', 15, 'avg')}, 6) AS mean15{_W}", "daily_counts")
def w6(spark, sf):
    return _win(spark, sf, mean15=ts.centered_mean(F.col("y"), ts.by_area(), 15))


@query("w9_ar_lags", "SELECT ward, date, " + ", ".join(f"lag(y, {k}) OVER w AS y_lag{k}" for k in range(1, 11)) + _W, "daily_counts")
def w9(spark, sf):
    return _win(spark, sf, **ts.lags("y", ts.by_area(), list(range(1, 11))))


@query("w10_panel_lags", "SELECT ward, week, " + ", ".join(f"y_lag{k}" for k in (1, 2, 4, 8)) + ", "
       + cols([f"{c}_lag1" for c in _WC]) + " FROM lagged", "lagged")
def w10(spark, sf):
    from frostline.functions.clean import valid_ward

    ready = pn.impute(panel_weather(spark, sf), _WC).where(valid_ward(F.col("ward")))
    w = ts.by_area("ward", "week")
    return rounded(ready.select("ward", "week", *[c.alias(n) for n, c in ts.lags("y", w, [1, 2, 4, 8]).items()],
                                *[F.lag(c).over(w).alias(f"{c}_lag1") for c in _WC]))


@query("w11_panel_rolls", f"""
SELECT ward, week, round({_full('y', '4 PRECEDING', '1 PRECEDING', 4, 'avg')}, 6) AS y_roll4,
  round({_full('y', '8 PRECEDING', '1 PRECEDING', 8, 'avg')}, 6) AS y_roll8 FROM panel WINDOW w AS (PARTITION BY ward ORDER BY week)""", "panel")
def w11(spark, sf):
    w = ts.by_area("ward", "week")
    return rounded(panel(spark, sf).select("ward", "week", ts.trailing_mean(F.col("y"), w, 4).alias("y_roll4"),
                                           ts.trailing_mean(F.col("y"), w, 8).alias("y_roll8")))


@query("w12_impute", f"SELECT ward, week, y, {cols(_WC)} FROM imputed", "imputed")
def w12(spark, sf):
    return rounded(pn.impute(panel_weather(spark, sf), _WC))


@query("w15_time_split", """
SELECT p.ward, p.week, CASE WHEN w.idx < w.n - 16 THEN 'train' WHEN w.idx < w.n - 8 THEN 'valid' ELSE 'test' END AS split
FROM panel p JOIN weeks w ON w.week = p.week""", "panel", "weeks")
def w15(spark, sf):
    return pn.time_split(panel(spark, sf)).select("ward", "week", "split")


@query("w16_sequences", """
SELECT ward, week, array_to_string(seq, ',') AS seq, y FROM (SELECT ward, week, y, list(y) OVER (PARTITION BY ward ORDER BY week
  ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS seq FROM panel) t WHERE len(seq) = 14""", "panel")
def w16(spark, sf):
    s = ts.sequences(panel(spark, sf), "y", 14, order="week")
    return s.select("ward", "week", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"), "y")


# --- composed tables ------------------------------------------------------------------------

_CALF = ["sin_doy", "cos_doy"]
_INTS = ["is_weekend", "dow_Mon", "dow_Tue", "dow_Wed", "dow_Thu", "dow_Fri", "dow_Sat"]


@query("m0_master", f"""SELECT ward, date, pothole_count, {cols(['daily_precip', 'daily_snow'])}, daily_ftc, {cols(_CALF)}, {', '.join(_INTS)} FROM master""", "master")
def m0(spark, sf):
    return rounded(master(spark, sf))


@query("m0b_features", f"""SELECT ward, date, CAST(Y AS BIGINT) AS "Y", {cols(['precip_roll', 'snow_roll'])}, CAST(ftc_roll AS BIGINT) AS ftc_roll,
  {', '.join(f'pothole_lag{k}' for k in range(1, 11))}, {cols(_CALF)}, {', '.join(_INTS)} FROM features""", "features")
def m0b(spark, sf):
    return rounded(features(spark, sf))


_MD = ["tmax_c", "tmin_c", "tmean_c", "precip_mm", "snow_cm", "t_range", "precip_15d", "sin_doy", "cos_doy"]


@query("m0c_model_df", "SELECT ward, date, " + ", ".join(
    cols([c]) if c in _MD else f"CAST({c} AS BIGINT) AS {c}" for c in pd_.MODEL_COLUMNS) + " FROM daily_model", "daily_model")
def m0c(spark, sf):
    return rounded(daily_model(spark, sf))


_WM_INT = ["y_lag1", "y_lag2", "y_lag4", "y_lag8", "weekofyear", "month"]


@query("m0d_weekly_model", f"SELECT ward, week, y, {cols(_MODEL_COLS, _WM_INT)} FROM weekly_model", "weekly_model")
def m0d(spark, sf):
    return rounded(weekly_model(spark, sf).select("ward", "week", "y", *_MODEL_COLS))


# --- splits and encodings ----------------------------------------------------------------------

@query("l6_stratified_split", """SELECT f.ward, f.date, CAST(f.Y AS BIGINT) AS "Y", s.split FROM features f JOIN split_days s ON s.date = f.date""",
       "features", "split_days")
def l6(spark, sf):
    return rounded(sp.make_split(features(spark, sf), calendar(spark)).select("ward", "date", "Y", "split"))


@query("l7_stratified_kfold", """
SELECT date, quarter, (row_number() OVER (PARTITION BY quarter ORDER BY md5('42:' || strftime(date, '%Y-%m-%d')), date) - 1) % 5 AS fold
FROM (SELECT date, quarter FROM split_days WHERE split = 'train' AND date IN (SELECT date FROM features)) t""", "split_days", "features")
def l7(spark, sf):
    train = sp.make_split(features(spark, sf), calendar(spark)).where(F.col("split") == "train")
    return rounded(sp.fold_days(train, 5))


_OH = ", ".join(f"CAST(coalesce(p.ward = l.w{i}, false) AS BIGINT) AS \"ward_Ward_{i}\"" for i in range(1, 9))


@query("c13_onehot_ward", """
SELECT p.ward AS ward, p.week AS week, """ + ", ".join(
    f"CAST(p.ward = 'Ward {i}' AND EXISTS (SELECT 1 FROM panel q WHERE q.ward = 'Ward {i}') AS BIGINT) AS \"ward_Ward_{i}\"" for i in range(1, 9))
       + " FROM panel p", "panel")
def c13(spark, sf):
    p = panel(spark, sf).select("ward", "week")
    train = pn.time_split(p).where(F.col("split") == "train")
    return rounded(encoding.one_hot(p, "ward", encoding.train_levels(train, "ward")))


_ST = ["precip_mm_sum", "tmean_c_mean", "y_roll4"]


@query("c27_standardize", """
SELECT t.ward, t.week, """ + ", ".join(
    f"coalesce(nullif(round((t.{c} - s.m_{c}) / CASE WHEN s.s_{c} > 0 THEN s.s_{c} ELSE 1 END, 6), 0), 0.0) AS {c}" for c in _ST) + """
FROM weekly_model t CROSS JOIN (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _ST) + """
  FROM weekly_model WHERE week < (SELECT week FROM (SELECT DISTINCT week FROM weekly_model) ORDER BY week DESC LIMIT 1 OFFSET 15)) s""", "weekly_model")
def c27(spark, sf):
    t = pn.time_split(materialize(weekly_model(spark, sf), "weekly-model"))
    return rounded(encoding.standardize(t, _ST, t.where(F.col("split") == "train")).select("ward", "week", *_ST))
