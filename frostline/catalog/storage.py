"""Queries that write a result to the shared folder and read it back, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.catalog.registry import query, rounded
from frostline.catalog.requests import _ADDR, timed
from frostline.catalog.roles import events_hourly, requests
from frostline.functions import clean
from frostline.models import linear, metrics as mt, registry as reg
from frostline.operators import rollups as ro
from frostline.operators.topn import top_k
from frostline.runtime import materialize, scratch_path
from frostline.schema import DEFAULT_PARAMS
from frostline.sources import sinks, weather as we


@query("s7_hourly_with_metadata", """
SELECT ward, 'station ' || ward AS label, count(*) AS hours, round(sum(temperature_2m), 6) AS temperature, round(sum(precipitation), 6) AS precipitation
FROM events_hourly GROUP BY ward""", "events_hourly")
def s7(spark, sf):
    """Hourly rows and their provenance records, stored and joined back as a dimension."""
    hourly, path = events_hourly(spark, sf), scratch_path(spark, "hourly")
    records = hourly.select("ward").distinct().withColumn("label", F.concat(F.lit("station "), "ward"))
    sinks.save_hourly(hourly, records, path)
    back, info = sinks.load_hourly(spark, path)
    return rounded(back.join(info.select("ward", "label"), "ward").groupBy("ward", "label").agg(
        F.count("*").alias("hours"), F.sum("temperature_2m").alias("temperature"), F.sum("precipitation").alias("precipitation")))


@query("s2_hourly_csv", """
SELECT count(*) AS n, round(sum(temperature_2m), 4) AS temperature, round(sum(snowfall), 4) AS snowfall, CAST(min(ts) AS VARCHAR) AS first_hour
FROM events_hourly""", "events_hourly")
def s2(spark, sf):
    """The same hours through CSV files."""
    path = f"{scratch_path(spark, 'hours')}/hours.csv"
    hours = events_hourly(spark, sf).select(F.col("ts").alias("date"), "temperature_2m", "precipitation", "snowfall")
    hours.write.option("header", True).csv(path)
    back = we.read_hourly(spark, path)
    return rounded(back.agg(
        F.count("*").alias("n"), F.sum("temperature_2m").alias("temperature"), F.sum("snowfall").alias("snowfall"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_hour")), 4)


@query("s8_ranked_services", """
SELECT service, count(*) AS n FROM requests WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 10""", "requests")
def s8(spark, sf):
    path, order = scratch_path(spark, "ranked"), (F.desc("n"), F.col("service"))
    sinks.save_ranked(ro.counts(requests(spark, sf, "service"), ["service"]), path, *order)
    return sinks.load_top(spark, path, 10, *order)


@query("s10_stored_model", """
SELECT ward, round(avg(response_hours), 4) AS y_pred, count(*) AS n FROM timed
WHERE ward IS NOT NULL AND response_hours IS NOT NULL AND response_hours >= 0 GROUP BY ward""", "timed")
def s10(spark, sf):
    """A model stored with its parameters, loaded and applied to the rows it was fitted on."""
    rows = materialize(timed(spark, sf, "ward").where("ward IS NOT NULL AND resolved_ts IS NOT NULL AND response_hours >= 0").select("ward", "response_hours"), "response-hours")
    path = scratch_path(spark, "model")
    reg.save(spark, reg.fit("mean", rows, [], "response_hours", "ward"), path, DEFAULT_PARAMS)
    stored, _ = reg.load(spark, path, "ward")
    scored = stored.predict(rows).groupBy("ward").agg(F.round(F.max("y_pred"), 4).alias("y_pred"), F.count("*").alias("n"))
    return rounded(scored, 4)


def mean_error(spark, sf):
    """(n, mae) of the mean as a model of the response hours. The hours are joined and stored once, for the fit and the
    score, and so is the result, for every record of it."""
    rows = materialize(timed(spark, sf).where("resolved_ts IS NOT NULL AND response_hours IS NOT NULL").select("response_hours"), "response-hours")
    scored = reg.fit("mean", rows, [], "response_hours", F.lit("all")).predict(rows).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("response_hours") - F.greatest("y_pred", F.lit(0.0)))).alias("mae"))
    return materialize(scored, "score")


@query("s11_metric_record", """
SELECT 'mean' AS model, stage, count(*) AS n, round(avg(abs(response_hours - m)), 4) AS mae FROM
  (SELECT response_hours, avg(response_hours) OVER () AS m FROM timed WHERE response_hours IS NOT NULL) t
CROSS JOIN (VALUES ('train'), ('evaluate')) s(stage) GROUP BY stage""", "timed")
def s11(spark, sf):
    scored, path = mean_error(spark, sf), scratch_path(spark, "metrics")
    for stage in ("train", "evaluate"):
        sinks.append_metrics(scored, path, "mean", stage)
    return rounded(spark.read.parquet(path).select("model", "stage", "n", "mae"), 4)


@query("c26_numeric_matrix", """
SELECT request_id, round(coalesce(response_hours, 0), 6) AS response_hours, round(coalesce(due_hours, 0), 6) AS due_hours, CAST(overdue AS DOUBLE) AS overdue
FROM timed""", "timed")
def c26(spark, sf):
    columns = ["response_hours", "due_hours", "overdue"]
    return rounded(clean.numeric_matrix(timed(spark, sf), columns).select("request_id", *columns))


@query("c16_parse_rate", f"""
SELECT count(*) AS n, round(avg(CAST(regexp_matches(addr, '{clean.ADDRESS_PATTERN}') AS INTEGER)), 6) AS parse_rate FROM ({_ADDR}) a""", "requests")
def c16_rate(spark, sf):
    a = requests(spark, sf, "address").select(clean.clean_address(F.col("address")).alias("addr"))
    number = clean.address_parts(F.col("addr"))["number"]
    return rounded(a.agg(F.count("*").alias("n"), F.avg(number.isNotNull().cast("int")).alias("parse_rate")))


@query("c16_top_streets", f"""
SELECT upper(trim(regexp_extract(addr, '{clean.ADDRESS_PATTERN}', 2))) AS street, count(*) AS n FROM ({_ADDR}) a
WHERE regexp_matches(addr, '{clean.ADDRESS_PATTERN}') GROUP BY 1 ORDER BY n DESC, street LIMIT 20""", "requests")
def c16_streets(spark, sf):
    a = requests(spark, sf, "address").select(clean.clean_address(F.col("address")).alias("addr"))
    street = F.upper(F.trim(clean.address_parts(F.col("addr"))["street"]))
    # A filter on the street would go in front of the projection and parse each address several times more; a null street counts 0.
    c = a.select(street.alias("street")).groupBy("street").agg(F.count("street").alias("n")).where("n > 0")
    return top_k(c, 20, F.desc("n"), F.col("street"))


_DAYS = """SELECT ward, date, CAST(n AS DOUBLE) AS y, CAST(i AS DOUBLE) AS x FROM (
  SELECT ward, add_ts::DATE AS date, count(*) AS n, date_diff('day', DATE '1992-01-01', add_ts::DATE) / 1000.0 AS i
  FROM requests WHERE ward IS NOT NULL AND add_ts IS NOT NULL GROUP BY 1, 2, 4) t"""


@query("m9_ridge_one_regressor", f"""
SELECT ward, round(sxy / (sxx + 1), 6) AS slope, round(my - mx * sxy / (sxx + 1), 6) AS intercept FROM (
  SELECT ward, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx
  FROM ({_DAYS}) d GROUP BY ward) s""", "requests")
def m9_one(spark, sf):
    """Ridge of daily counts on the day number: the closed form with one regressor."""
    day = F.to_date("add_ts")
    d = (
        requests(spark, sf, "ward").where("ward IS NOT NULL AND add_ts IS NOT NULL").groupBy("ward", day.alias("date")).agg(F.count("*").cast("double").alias("y"))
        .withColumn("x", F.datediff("date", F.lit("1992-01-01").cast("date")) / 1000.0)
    )
    table = linear.ridge(d, ["x"], "y", "ward", alpha=1.0)
    return rounded(table.select(F.col("g").alias("ward"), F.col("terms")[1].alias("slope"), F.col("terms")[0].alias("intercept")))


@query("m4_vif_two_features", f"""
SELECT ward, f.feature, round(1 / (1 - sxy * sxy / (sxx * syy)), 4) AS vif FROM (
  SELECT ward, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM ({_DAYS}) d GROUP BY ward) s
CROSS JOIN (VALUES ('x'), ('y')) f(feature)""", "requests")
def m4_two(spark, sf):
    """Variance inflation of two columns: both 1 / (1 - r2) with the uncentred r."""
    day = F.to_date("add_ts")
    d = (
        requests(spark, sf, "ward").where("ward IS NOT NULL AND add_ts IS NOT NULL").groupBy("ward", day.alias("date")).agg(F.count("*").cast("double").alias("y"))
        .withColumn("x", F.datediff("date", F.lit("1992-01-01").cast("date")) / 1000.0)
    )
    return rounded(linear.vif(d, ["x", "y"], "ward").withColumnRenamed("g", "ward"), 4)


@query("s3_station_daily", """
SELECT 38 + CAST(substr(ward, 6) AS INTEGER) / 10.0::DOUBLE AS latitude, -77.05::DOUBLE AS longitude, 'GMT' AS timezone, CAST(ts AS DATE) AS date,
  round(sum(precipitation), 4) AS precip_mm, CAST(count(*) FILTER (WHERE precipitation > 0) AS DOUBLE) AS precip_hours, round(sum(snowfall), 4) AS snow_cm,
  round(max(temperature_2m), 3) AS tmax_c, round(min(temperature_2m), 3) AS tmin_c, count(*) AS rh_mean
FROM events_hourly GROUP BY ward, CAST(ts AS DATE)""", "events_hourly")
def s3(spark, sf):
    """Daily files of every station, written and read back with the station's columns."""
    hourly, path = events_hourly(spark, sf), scratch_path(spark, "stations")
    number = F.substring("ward", 6, 9).cast("int")
    stations = hourly.select("ward").distinct().withColumns({
        "latitude": F.lit(38) + number / 10, "longitude": F.lit(-77.05), "elevation": F.lit(54.0), "utc_offset_seconds": F.lit(0), "timezone": F.lit("GMT"), "timezone_abbreviation": F.lit("GMT")})
    daily = hourly.groupBy("ward", F.to_date("ts").alias("date")).agg(
        F.round(F.sum("precipitation"), 4).alias("precip_mm"), F.count_if(F.col("precipitation") > 0).cast("double").alias("precip_hours"),
        F.round(F.sum("snowfall"), 4).alias("snow_cm"), F.round(F.max("temperature_2m"), 3).alias("tmax_c"), F.round(F.min("temperature_2m"), 3).alias("tmin_c"), F.count("*").alias("rh_mean"))
    sinks.save_station_files(daily, stations, path)
    return rounded(we.read_station_daily(spark, path).select(
        "latitude", "longitude", "timezone", "date", "precip_mm", "precip_hours", "snow_cm", "tmax_c", "tmin_c", "rh_mean"), 4)


@query("s4_station_dimension", """
SELECT e.ward, label, variable, count(*) AS hours, round(sum(temperature_2m), 6) AS temperature FROM events_hourly e
LEFT JOIN (SELECT ward, 'station ' || ward AS label, min(CAST(ts AS DATE)) + CAST(substr(ward, 6) AS INTEGER) AS first_day,
    min(CAST(ts AS DATE)) + 20 + CAST(substr(ward, 6) AS INTEGER) AS last_day, unnest(['temperature_2m', 'precipitation']) AS variable
  FROM events_hourly GROUP BY ward) r ON r.ward = e.ward AND CAST(ts AS DATE) BETWEEN first_day AND last_day
GROUP BY e.ward, label, variable""", "events_hourly")
def s4(spark, sf):
    """Provenance records as nested JSON, read back and joined to the hours of their span."""
    hourly, path = events_hourly(spark, sf), scratch_path(spark, "records")
    number, first = F.substring("ward", 6, 9).cast("int"), F.min(F.to_date("ts"))
    records = hourly.groupBy("ward").agg(first.alias("first")).select(
        "ward", F.concat(F.lit("station "), "ward").alias("label"), F.date_add("first", number).cast("string").alias("start_date"),
        F.date_add("first", 20 + number).cast("string").alias("end_date"), F.array(F.lit("temperature_2m"), F.lit("precipitation")).alias("variables"))
    sinks.save_metadata(records, path)
    found = we.with_station_records(hourly, we.read_metadata(spark, path))
    return rounded(found.groupBy("ward", "label", "variable").agg(F.count("*").alias("hours"), F.sum("temperature_2m").alias("temperature")))


@query("s6_type_feature_file", """
SELECT service, CAST(count(*) AS DOUBLE) AS n_requests, round(avg(response_hours), 4) AS mean_rt, CAST(count(response_hours) AS DOUBLE) AS n_requests_2
FROM timed WHERE service IS NOT NULL GROUP BY service""", "timed")
def s6(spark, sf):
    """A feature file whose counts stand under one name twice."""
    path = scratch_path(spark, "type-features")
    found = timed(spark, sf, "service").where("service IS NOT NULL").groupBy("service").agg(
        F.count("*").alias("n_requests1"), F.avg("response_hours").alias("mean_rt"), F.count("response_hours").alias("n_requests3"))
    found.write.option("header", True).csv(path)
    return rounded(we.read_type_features(spark, path), 4)


@query("s11_metric_rerun", """
SELECT 'first' AS run, 'mean' AS model, stage, count(*) AS n, round(avg(abs(response_hours - m)), 4) AS mae FROM
  (SELECT response_hours, avg(response_hours) OVER () AS m FROM timed WHERE response_hours IS NOT NULL) t
CROSS JOIN (VALUES ('train'), ('evaluate')) s(stage) GROUP BY stage""", "timed")
def s11_rerun(spark, sf):
    """A run recorded twice reads back once."""
    scored, path = mean_error(spark, sf), scratch_path(spark, "runs")
    for stage in ("train", "evaluate", "train", "evaluate"):
        sinks.record_metrics(scored, path, "first", "mean", stage)
    return rounded(spark.read.parquet(path).select("run", "model", "stage", "n", "mae"), 4)


# Predictions of fitted models: the ward's mean, and its ridge on the day number, learned on all but the last 360 days.
_FITTED = f"""SELECT model, split, abs(y - yp) AS e FROM (
  SELECT d.ward, d.y, d.split, m.model, CASE WHEN m.model = 'mean' THEN f.my ELSE greatest(f.my - f.mx * f.sxy / (f.sxx + 1) + d.x * f.sxy / (f.sxx + 1), 0) END AS yp
  FROM (SELECT *, CASE WHEN date <= last - 360 THEN 'train' WHEN date <= last - 180 THEN 'valid' ELSE 'test' END AS split
        FROM (SELECT *, max(date) OVER () AS last FROM ({_DAYS}) a) b) d
  JOIN (SELECT ward, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx
        FROM (SELECT *, max(date) OVER () AS last FROM ({_DAYS}) a) b WHERE date <= last - 360 GROUP BY ward) f ON f.ward = d.ward
  CROSS JOIN (VALUES ('mean'), ('ridge')) m(model)) p"""


def fitted_predictions(spark, sf):
    """(model, split, ward, date, y_true, y_pred) of models fitted on the training days, stored once for every reader."""
    day = F.to_date("add_ts")
    d = (
        requests(spark, sf, "ward").where("ward IS NOT NULL AND add_ts IS NOT NULL").groupBy("ward", day.alias("date")).agg(F.count("*").cast("double").alias("y"))
        .withColumn("x", F.datediff("date", F.lit("1992-01-01").cast("date")) / 1000.0)
    )
    left = F.datediff(d.agg(F.max("date")).scalar(), F.col("date"))
    d = materialize(d.withColumn("split", F.when(left >= 360, "train").when(left >= 180, "valid").otherwise("test")), "days")
    out = None
    for name, features in (("mean", []), ("ridge", ["x"])):
        fitted = reg.fit(name, d.where("split = 'train'"), features, "y", "ward")
        p = fitted.predict(d).select(F.lit(name).alias("model"), "split", "ward", "date", F.col("y").alias("y_true"), "y_pred").where("y_pred IS NOT NULL")
        out = p if out is None else out.unionByName(p)
    return materialize(out, "predictions")


@query("m7_fitted_models", f"""
SELECT model, split, count(*) AS n, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, CASE model WHEN 'mean' THEN 1 ELSE 2 END::BIGINT AS model_order,
  CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END::BIGINT AS split_order FROM ({_FITTED}) q GROUP BY model, split""", "requests")
def m7_fitted(spark, sf):
    return rounded(mt.compare_models(fitted_predictions(spark, sf), ["mean", "ridge"], ["train", "valid", "test"]))


@query("a23_model_metrics", f"""
SELECT split, round(avg(e) FILTER (WHERE model = 'mean'), 6) AS mean_mae, round(sqrt(avg(e * e) FILTER (WHERE model = 'mean')), 6) AS mean_rmse,
  round(avg(e) FILTER (WHERE model = 'ridge'), 6) AS ridge_mae, round(sqrt(avg(e * e) FILTER (WHERE model = 'ridge')), 6) AS ridge_rmse FROM ({_FITTED}) q GROUP BY split""", "requests")
def a23_models(spark, sf):
    """Model by metric, a row per split."""
    m = mt.metrics(fitted_predictions(spark, sf), ["model", "split"])
    return rounded(m.groupBy("split").pivot("model", ["mean", "ridge"]).agg(F.max("mae").alias("mae"), F.max("rmse").alias("rmse")))


@query("a23_split_quarter", """
SELECT split, count(*) FILTER (WHERE q = 1) AS q1, count(*) FILTER (WHERE q = 2) AS q2, count(*) FILTER (WHERE q = 3) AS q3, count(*) FILTER (WHERE q = 4) AS q4 FROM (
  SELECT date_part('quarter', add_ts) AS q, CASE WHEN CAST(add_ts AS DATE) <= last - 360 THEN 'train' WHEN CAST(add_ts AS DATE) <= last - 180 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT add_ts, max(CAST(add_ts AS DATE)) OVER () AS last FROM requests WHERE add_ts IS NOT NULL) a) b GROUP BY split""", "requests")
def a23_quarter(spark, sf):
    r = requests(spark, sf).where("add_ts IS NOT NULL").select("add_ts")
    left = F.datediff(r.agg(F.max(F.to_date("add_ts"))).scalar(), F.to_date("add_ts"))
    d = r.select(F.when(left >= 360, "train").when(left >= 180, "valid").otherwise("test").alias("split"), F.concat(F.lit("q"), F.quarter("add_ts").cast("string")).alias("q"))
    return ro.zero_filled_pivot(d, "split", "q", ["q1", "q2", "q3", "q4"])
