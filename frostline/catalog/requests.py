"""Queries on the request table: sources, cleaning, predicates, rollups, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.catalog.registry import query, rounded
from frostline.catalog.roles import FLAG_WORD, requests, table, ward_orders
from frostline.functions import clean, dates
from frostline.operators import profile as prof
from frostline.operators import rollups as ro
from frostline.operators import topn
from frostline.runtime import scratch_path
from frostline.sources import requests as src

TYPE = "red widget"
# Ordered keyword list of the tagging query.
KEYWORDS = ["widget", "ring", "plate", "rod", "bolt", "gear", "small", "large", "red", "blue"]


def timed(spark, sf, *need):
    return clean.with_lateness(requests(spark, sf, *need))


# --- sources and cleaning -------------------------------------------------------

@query("s1_scan_requests", """
SELECT order_id AS request_id, ward, CASE WHEN order_id % 50 = 0 THEN NULL ELSE date END AS add_date,
  CASE WHEN order_id % 7 = 0 THEN NULL ELSE price END AS lat
FROM ward_orders""", "ward_orders")
def s1(spark, sf):
    o = ward_orders(spark, sf)
    path = scratch_path(spark, "requests-csv")
    o.select(
        F.col("order_id").alias("SERVICEREQUESTID"),
        F.when(F.col("order_id") % 50 == 0, "garbage").otherwise(
            F.date_format("date", "yyyy/MM/dd HH:mm:ss")).alias("ADDDATE"),
        F.col("ward").alias("WARD"),
        F.when(F.col("order_id") % 7 == 0, "x").otherwise(F.col("price").cast("string")).alias("LATITUDE"),
    ).write.option("header", True).csv(path)
    r = src.read_requests(spark, path, "yyyy/MM/dd HH:mm:ss")
    return r.select(F.col("request_id").cast("bigint").alias("request_id"), "ward",
                    F.to_date("add_ts").alias("add_date"), "lat")


@query("c1_normalize_columns", """
SELECT order_id AS request_id, ward, date AS add_date,
  CASE WHEN date >= DATE '1998-01-01' THEN price END AS lat, count(*) OVER (PARTITION BY ward) AS n_ward
FROM ward_orders""", "ward_orders")
def c1(spark, sf):
    from pyspark.sql import Window

    o = ward_orders(spark, sf)
    early = o.where(F.col("date") < "1998-01-01").select(
        F.col("order_id").alias(" Request Id"), F.col("date").alias("Created Date "), F.col("ward").alias("Ward_ID"))
    late = o.where(F.col("date") >= "1998-01-01").select(
        F.col("order_id").alias("ServiceRequestId"), F.col("date").alias("AddDate"), F.col("ward").alias("ward"),
        F.col("price").alias(" Lat "), F.lit(1).alias("unused"))
    u = src.union_years([src.canonical(early), src.canonical(late)])
    n = u.groupBy("ward").agg(F.count("*").alias("n_ward")).withColumnRenamed("ward", "_w")
    return u.join(n, F.col("ward").eqNullSafe(F.col("_w")), "left").select(
        "request_id", "ward", F.col("add_ts").alias("add_date"), "lat", "n_ward")


@query("c3_coerce", """
SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS add_date,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Ward ' || CAST(o_orderkey % 8 + 1 AS VARCHAR) END AS ward
FROM orders""")
def c3(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        k.alias("request_id"),
        F.when(k % 7 == 0, "garbage").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t"),
        F.when(k % 5 == 0, "x").when(k % 11 == 0, "nan").otherwise(F.col("o_totalprice").cast("string")).alias("a"),
        F.when(k % 3 == 0, " nan ").otherwise(F.concat(F.lit(" Ward "), (k % 8 + 1).cast("string"))).alias("w"))
    return raw.select(
        "request_id", F.to_date(clean.to_ts(F.col("t"), "yyyy-MM-dd HH:mm:ss")).alias("add_date"),
        clean.to_number(F.col("a")).alias("amount"), clean.null_text_wards(F.col("w")).alias("ward"))


@query("c5_durations", """
SELECT request_id, round(due_hours, 6) AS due_hours, round(response_hours, 6) AS response_hours FROM timed""", "timed")
def c5(spark, sf):
    return rounded(timed(spark, sf).select("request_id", "due_hours", "response_hours"))


@query("c6_sla_flags", """
SELECT request_id, CAST(overdue AS BIGINT) AS overdue, CAST(on_time AS BIGINT) AS on_time,
  round(late_hours, 6) AS late_hours FROM timed""", "timed")
def c6(spark, sf):
    return rounded(timed(spark, sf).select("request_id", "overdue", "on_time", "late_hours"))


@query("c8_sla_rates", """
SELECT count(*) AS n, CAST(sum(has_both) AS BIGINT) AS n_both, round(avg(overdue), 6) AS overdue_rate,
  round(avg(on_time) FILTER (WHERE has_both = 1), 6) AS on_time_rate FROM timed""", "timed")
def c8(spark, sf):
    return rounded(ro.overall_rates(timed(spark, sf)))


@query("c9_calendar_parts", """
SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS date, date_part('year', o_orderdate) AS year,
  date_part('month', o_orderdate) AS month, date_part('week', o_orderdate) AS iso_week,
  date_part('doy', o_orderdate) AS day_of_year, date_part('isodow', o_orderdate) - 1 AS day_of_week,
  dayname(o_orderdate) AS day_name, date_part('quarter', o_orderdate) AS quarter,
  strftime(o_orderdate, '%Y-%m') AS month_text, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def c9(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(o.select(F.col("o_orderkey").alias("request_id"),
                            *[c.alias(n) for n, c in dates.calendar_parts(F.col("o_orderdate")).items()]))


@query("c11_fourier", """
SELECT request_id, CAST(dow >= 5 AS BIGINT) AS is_weekend,
  CASE WHEN abs(sd) < 5e-10 THEN 0.0 ELSE round(sd, 9) END AS sin_doy, CASE WHEN abs(cd) < 5e-10 THEN 0.0 ELSE round(cd, 9) END AS cos_doy,
  CASE WHEN abs(sw) < 5e-10 THEN 0.0 ELSE round(sw, 9) END AS sin_woy, CASE WHEN abs(cw) < 5e-10 THEN 0.0 ELSE round(cw, 9) END AS cos_woy
FROM (SELECT o_orderkey AS request_id, date_part('isodow', o_orderdate) - 1 AS dow,
  sin(2 * pi() * date_part('doy', o_orderdate) / 365) AS sd, cos(2 * pi() * date_part('doy', o_orderdate) / 365) AS cd,
  sin(2 * pi() * date_part('week', o_orderdate) / 52) AS sw, cos(2 * pi() * date_part('week', o_orderdate) / 52) AS cw
  FROM orders) t""")
def c11(spark, sf):
    d = F.to_date("o_orderdate")
    return rounded(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), dates.is_weekend(d).alias("is_weekend"),
        *[c.alias(n) for n, c in {**dates.fourier(F.dayofyear(d), 365, "doy"),
                                  **dates.fourier(F.weekofyear(d), 52, "woy")}.items()]), 9)


_DOW = ", ".join(f"CAST(date_part('isodow', o_orderdate) = {i + 1} AS BIGINT) AS dow_{d}"
                 for i, d in enumerate(["Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]))


@query("c12_onehot_dow", f"SELECT o_orderkey AS request_id, {_DOW} FROM orders")
def c12(spark, sf):
    return rounded(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        *[c.alias(n) for n, c in dates.dow_dummies(F.to_date("o_orderdate")).items()]))


@query("c14_clean_type", """
SELECT coalesce(lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), 'unknown') AS service, count(*) AS n
FROM (SELECT CASE WHEN p_partkey % 9 <> 0 THEN '  ' || upper(p_name) || chr(9) END AS t FROM part) x GROUP BY 1""")
def c14(spark, sf):
    raw = table(spark, sf, "part").select(F.when(
        F.col("p_partkey") % 9 != 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t"))).alias("t"))
    return raw.groupBy(clean.clean_label(F.col("t")).alias("service")).agg(F.count("*").alias("n"))


_ADDR = """SELECT coalesce(regexp_replace(regexp_replace(address, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 'unknown') AS addr FROM requests"""


@query("c15_address_clean", f"""
SELECT count(*) AS n, round(avg(CAST(addr IN ('unknown', '') AS INTEGER)), 6) AS missing_share,
  round(avg(CAST(regexp_matches(addr, '\\b\\d{{5}}\\b') AS INTEGER)), 6) AS zip_share,
  round(avg(length(addr)), 6) AS len_mean, round(stddev_samp(length(addr)), 6) AS len_std,
  min(length(addr)) AS len_min, max(length(addr)) AS len_max, round(CAST(median(length(addr)) AS DOUBLE), 6) AS len_median
FROM ({_ADDR}) a""", "requests")
def c15(spark, sf):
    from frostline.operators.quantiles import aggregate

    a = requests(spark, sf, "address").select(clean.clean_address(F.col("address")).alias("addr"))
    n = F.length("addr")
    return rounded(aggregate(
        a, [],
        {"n": F.count("*"), "missing_share": F.avg(F.col("addr").isin("unknown", "").cast("int")),
         "zip_share": F.avg(F.col("addr").rlike(clean.ZIP_PATTERN).cast("int")),
         "len_mean": F.avg(n), "len_std": F.stddev_samp(n), "len_min": F.min(n), "len_max": F.max(n)},
        {"len_median": (n, 0.5)}))


@query("c16_address_parse", f"""
SELECT number, upper(trim(street)) AS street, unit, count(*) AS n
FROM (SELECT nullif(regexp_extract(addr, '{clean.ADDRESS_PATTERN}', 1), '') AS number,
  nullif(regexp_extract(addr, '{clean.ADDRESS_PATTERN}', 2), '') AS street,
  nullif(regexp_extract(addr, '{clean.ADDRESS_PATTERN}', 3), '') AS unit FROM ({_ADDR}) a) p
GROUP BY 1, 2, 3""", "requests")
def c16(spark, sf):
    a = requests(spark, sf, "address").select(clean.clean_address(F.col("address")).alias("addr"))
    p = a.select(*[c.alias(n) for n, c in clean.address_parts(F.col("addr")).items()])
    return p.groupBy("number", F.upper(F.trim("street")).alias("street"), "unit").agg(F.count("*").alias("n"))


@query("c19_clip_p99", """
SELECT request_id, round(least(response_hours, (SELECT quantile_cont(response_hours, 0.99) FROM timed)), 6) AS response_hours
FROM timed WHERE response_hours IS NOT NULL""", "timed")
def c19(spark, sf):
    t = timed(spark, sf).select("request_id", "response_hours").where(F.col("response_hours").isNotNull())
    return rounded(ro.clip_at_quantile(t, "response_hours", 0.99))


@query("c23_ward_code", """
SELECT ward, row_number() OVER (ORDER BY min(request_id), ward) - 1 AS code
FROM requests WHERE ward IS NOT NULL GROUP BY ward""", "requests")
def c23(spark, sf):
    return rounded(ro.first_seen_code(requests(spark, sf, "ward"), "ward", "request_id"))


# --- predicates -----------------------------------------------------------------

@query("f1_exact_filter", f"""
SELECT request_id, ward, service FROM requests WHERE ward = 'Ward 3' AND service = '{TYPE}'""", "requests")
def f1(spark, sf):
    r = requests(spark, sf, "ward", "service")
    return r.where((F.col("ward") == "Ward 3") & (F.col("service") == TYPE)).select("request_id", "ward", "service")


@query("f2_contains", """
SELECT CAST(coalesce(contains(lower(service), 'widget'), false) AS BIGINT) AS flagged, count(*) AS n
FROM requests GROUP BY 1""", "requests")
def f2(spark, sf):
    r = requests(spark, sf, "service")
    return r.groupBy(clean.contains_ci(F.col("service"), "WIDGET").cast("bigint").alias("flagged")).agg(
        F.count("*").alias("n"))


@query("f3_word_regex", """
SELECT service, count(*) AS n FROM requests WHERE regexp_matches(service, '(?i)\\bwidget(s)?\\b')
GROUP BY service""", "requests")
def f3(spark, sf):
    r = requests(spark, sf, "service").where(clean.word_ci(F.col("service"), FLAG_WORD))
    return r.groupBy("service").agg(F.count("*").alias("n"))


@query("f4_ward_filter", """
SELECT w AS ward, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 10 = 0 THEN 'nan' WHEN c_custkey % 10 = 1 THEN 'Ward 9' WHEN c_custkey % 10 = 2 THEN ''
    WHEN c_nationkey <> 24 THEN 'Ward ' || CAST(c_nationkey % 8 + 1 AS VARCHAR) END AS w
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey) t
WHERE w NOT IN ('Null', 'nan', 'None', 'NaN', '') AND regexp_matches(w, '^Ward\\s+[1-8]$') GROUP BY w""")
def f4(spark, sf):
    c = table(spark, sf, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == k, "left").select(
        F.when(k % 10 == 0, "nan").when(k % 10 == 1, "Ward 9").when(k % 10 == 2, "")
        .when(n != 24, F.concat(F.lit("Ward "), (n % 8 + 1).cast("string"))).alias("w"))
    w = o.select(clean.null_text_wards(F.col("w")).alias("ward")).where(clean.valid_ward(F.col("ward")))
    return w.groupBy("ward").agg(F.count("*").alias("n"))


@query("f5_range_topk", """
SELECT * FROM (SELECT 'fast' AS band, service, count(*) AS n FROM timed WHERE response_hours < 100 AND service IS NOT NULL
  GROUP BY service ORDER BY n DESC, service LIMIT 50) a
UNION ALL SELECT * FROM (SELECT 'slow' AS band, service, count(*) AS n FROM timed WHERE response_hours > 1000 AND service IS NOT NULL
  GROUP BY service ORDER BY n DESC, service LIMIT 50) b""", "timed")
def f5(spark, sf):
    t = timed(spark, sf, "service")
    h = F.col("response_hours")
    # One scan counts both bands; each band's ranking then sees only services.
    c = (t.where((h < 100) | (h > 1000)).where(F.col("service").isNotNull())
         .groupBy(F.when(h < 100, "fast").otherwise("slow").alias("band"), "service").agg(F.count("*").alias("n")))
    return topn.top_n_per_group(c, ["band"], 50, [F.desc("n"), F.col("service")])


@query("f9_semi_topn", """
SELECT service, ward, count(*) AS n FROM requests WHERE service IN (
  SELECT service FROM requests WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 25)
GROUP BY service, ward""", "requests")
def f9(spark, sf):
    r = requests(spark, sf, "service", "ward")
    return ro.in_top_values(r, "service", 25).groupBy("service", "ward").agg(F.count("*").alias("n"))


_KW = "CASE " + " ".join(f"WHEN contains(lower(service), '{k}') THEN '{k}'" for k in KEYWORDS) + " END"


@query("f10_keyword_tag", f"""
SELECT service, count(*) AS n, {_KW} AS keyword FROM requests
WHERE service IS NOT NULL AND {_KW} IS NOT NULL GROUP BY service""", "requests")
def f10(spark, sf):
    return ro.keyword_tags(requests(spark, sf, "service"), KEYWORDS).select("service", "n", "keyword")


# --- rollups ----------------------------------------------------------------------

def _with_total(key_sql: str, src_sql: str) -> str:
    return f"""SELECT {key_sql}, num_requests, count(*) OVER () AS n_keys, round(avg(num_requests) OVER (), 6) AS avg_per_key
FROM ({src_sql}) t"""


@query("a1_counts_day", _with_total("date", """SELECT CAST(add_ts AS DATE) AS date, count(*) AS num_requests
  FROM requests WHERE add_ts IS NOT NULL GROUP BY 1"""), "requests")
def a1_day(spark, sf):
    r = requests(spark, sf).select(F.to_date("add_ts").alias("date"))
    return rounded(ro.counts_with_total(r, ["date"]))


@query("a1_counts_week", _with_total("year, week", """SELECT date_part('year', add_ts) AS year, date_part('week', add_ts) AS week,
  count(*) AS num_requests FROM requests WHERE add_ts IS NOT NULL GROUP BY 1, 2"""), "requests")
def a1_week(spark, sf):
    r = requests(spark, sf).select(F.year("add_ts").alias("year"), F.weekofyear("add_ts").alias("week"))
    return rounded(ro.counts_with_total(r, ["year", "week"]))


@query("a1_counts_year", _with_total("year", """SELECT date_part('year', add_ts) AS year, count(*) AS num_requests
  FROM requests WHERE add_ts IS NOT NULL GROUP BY 1"""), "requests")
def a1_year(spark, sf):
    return rounded(ro.counts_with_total(requests(spark, sf).select(F.year("add_ts").alias("year")), ["year"]))


@query("a1_counts_service", _with_total("service", """SELECT service, count(*) AS num_requests
  FROM requests WHERE service IS NOT NULL GROUP BY 1"""), "requests")
def a1_service(spark, sf):
    return rounded(ro.counts_with_total(requests(spark, sf, "service"), ["service"]))


@query("a1_counts_ward", _with_total("ward", """SELECT ward, count(*) AS num_requests
  FROM requests WHERE ward IS NOT NULL GROUP BY 1"""), "requests")
def a1_ward(spark, sf):
    return rounded(ro.counts_with_total(requests(spark, sf, "ward"), ["ward"]))


@query("a2_type_summary", """
SELECT service, count(*) AS n, round(median(response_hours), 6) AS median_rt, round(quantile_cont(response_hours, 0.9), 6) AS p90_rt,
  round(avg(overdue), 6) AS overdue_rate, round(avg(on_time), 6) AS on_time_rate FROM timed
WHERE service IN (SELECT service FROM timed WHERE service IS NOT NULL GROUP BY service ORDER BY count(*) DESC, service LIMIT 25)
GROUP BY service""", "timed")
def a2(spark, sf):
    return rounded(ro.type_summary(timed(spark, sf, "service")).orderBy(F.desc("median_rt"), "service"))


@query("a3_ward_summary", """
SELECT ward, count(*) AS n, round(median(response_hours), 6) AS median_rt, round(quantile_cont(response_hours, 0.9), 6) AS p90_rt,
  round(avg(overdue), 6) AS overdue_rate FROM timed WHERE ward IS NOT NULL GROUP BY ward""", "timed")
def a3(spark, sf):
    return rounded(ro.lateness_summary(timed(spark, sf, "ward"), "ward").orderBy(F.desc("median_rt"), "ward"))


@query("a4_monthly", """
SELECT coalesce(strftime(add_ts, '%Y-%m'), 'NaT') AS month, count(*) AS n, round(median(response_hours), 6) AS median_rt,
  round(avg(overdue), 6) AS overdue_rate FROM (SELECT * REPLACE (CASE WHEN request_id % 100 = 0 THEN NULL ELSE add_ts END AS add_ts) FROM timed) t
GROUP BY 1""", "timed")
def a4(spark, sf):
    t = timed(spark, sf).withColumn("add_ts", F.when(F.col("request_id") % 100 != 0, F.col("add_ts")))
    return rounded(ro.monthly_summary(t))


@query("a5_flag_monthly", """
SELECT strftime(add_ts, '%Y-%m') AS month, CAST(sum(CAST(contains(lower(service), 'widget') AS INTEGER)) AS BIGINT) AS flagged
FROM requests GROUP BY 1""", "requests")
def a5(spark, sf):
    r = requests(spark, sf, "service")
    return r.groupBy(dates.month_text(F.col("add_ts")).alias("month")).agg(
        F.count_if(clean.contains_ci(F.col("service"), FLAG_WORD)).alias("flagged"))


@query("a6_ward_share", """
SELECT ward, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT ward, count(*) AS n FROM requests
  WHERE ward IS NOT NULL AND regexp_matches(service, '(?i)\\bwidget(s)?\\b') GROUP BY ward) t""", "requests")
def a6(spark, sf):
    r = requests(spark, sf, "service", "ward").where(clean.word_ci(F.col("service"), FLAG_WORD))
    return rounded(ro.shares(r, "ward"))


@query("a7_seasonality", """
SELECT 'month' AS part, strftime(add_ts, '%Y-%m') AS value, count(*) AS n FROM flagged GROUP BY 2
UNION ALL SELECT 'week', strftime(date_trunc('week', add_ts), '%Y-%m-%d'), count(*) FROM flagged GROUP BY 2
UNION ALL SELECT 'day', d.name, f.n FROM (VALUES (1,'Monday'),(2,'Tuesday'),(3,'Wednesday'),(4,'Thursday'),(5,'Friday'),(6,'Saturday'),(7,'Sunday')) d(i, name)
  LEFT JOIN (SELECT date_part('isodow', add_ts) AS i, count(*) AS n FROM flagged GROUP BY 1) f ON f.i = d.i""", "flagged")
def a7(spark, sf):
    r = requests(spark, sf, "service").where(clean.word_ci(F.col("service"), FLAG_WORD)).dropna(subset=["add_ts"])
    by_day = ro.weekday_counts(r).select(F.lit("day").alias("part"), F.col("day_name").alias("value"), "n")
    # Month and week come from one daily count.
    per_day = r.groupBy(F.to_date("add_ts").alias("d")).agg(F.count("*").alias("n"))
    parts = per_day.select(F.explode(F.array(
        F.struct(F.lit("month").alias("part"), F.date_format("d", "yyyy-MM").alias("value"), "n"),
        F.struct(F.lit("week").alias("part"), dates.week_start(F.col("d")).cast("string").alias("value"), "n"),
    )).alias("x")).select("x.*").groupBy("part", "value").agg(F.sum("n").alias("n"))
    return parts.unionByName(by_day)


def _active(part_sql: str, name: str) -> str:
    return f"""SELECT ward, {name}, n, CAST(sum(n) OVER (PARTITION BY ward) AS BIGINT) AS total, round(avg(n) OVER (PARTITION BY ward), 6) AS mean_per_active
FROM (SELECT ward, {part_sql} AS {name}, count(*) AS n FROM requests WHERE ward IS NOT NULL AND add_ts IS NOT NULL GROUP BY 1, 2) t"""


@query("a8_ward_doy", _active("date_part('doy', add_ts)", "doy"), "requests")
def a8_doy(spark, sf):
    r = requests(spark, sf, "ward").withColumn("doy", F.dayofyear("add_ts"))
    return rounded(ro.mean_per_active(r, "ward", "doy"))


@query("a8_ward_woy", _active("date_part('week', add_ts)", "woy"), "requests")
def a8_woy(spark, sf):
    r = requests(spark, sf, "ward").withColumn("woy", F.weekofyear("add_ts"))
    return rounded(ro.mean_per_active(r, "ward", "woy"))


@query("a9_daily_stats", """
SELECT count(*) AS n_days, round(avg(n), 6) AS mean, round(CAST(median(n) AS DOUBLE), 6) AS median, round(stddev_samp(n), 6) AS std,
  min(n) AS min, max(n) AS max, (SELECT doy FROM c ORDER BY n DESC, doy LIMIT 1) AS argmax_day,
  (SELECT doy FROM c ORDER BY n, doy LIMIT 1) AS argmin_day FROM c""", "flag_doy")
def a9(spark, sf):
    r = requests(spark, sf, "service").where(clean.contains_ci(F.col("service"), FLAG_WORD))
    return rounded(ro.daily_count_stats(r.withColumn("doy", F.dayofyear("add_ts")), "doy"))


@query("a10_hotspots", """
SELECT round_even(lat, 3) AS lat_bin, round_even(lon, 3) AS lon_bin, count(*) AS n FROM requests
WHERE lat IS NOT NULL AND lon IS NOT NULL AND contains(service, 'widget') GROUP BY 1, 2""", "requests")
def a10(spark, sf):
    r = requests(spark, sf, "service", "geo").where(clean.contains_ci(F.col("service"), FLAG_WORD))
    return ro.hotspots(r)


@query("a11_ward_geo", """
SELECT ward, count(*) AS count, round(median(lat), 6) AS lat_median, round(median(lon), 6) AS lon_median,
  round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max
FROM requests WHERE ward IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY ward""", "requests")
def a11(spark, sf):
    return rounded(ro.ward_geography(requests(spark, sf, "ward", "geo")))


@query("a12_ward_centroid", """
SELECT ward, round(avg(lat), 6) AS avg_latitude, round(avg(lon), 6) AS avg_longitude FROM requests
WHERE regexp_matches(ward, '^Ward\\s+[1-8]$') AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY ward""", "requests")
def a12(spark, sf):
    return rounded(ro.ward_centroids(requests(spark, sf, "ward", "geo").where(clean.valid_ward(F.col("ward")))))


@query("a13_bbox", """
SELECT count(*) AS n, round(min(lat) - (max(lat) - min(lat)) * 0.05, 6) AS lat_lo, round(max(lat) + (max(lat) - min(lat)) * 0.05, 6) AS lat_hi,
  round(min(lon) - (max(lon) - min(lon)) * 0.05, 6) AS lon_lo, round(max(lon) + (max(lon) - min(lon)) * 0.05, 6) AS lon_hi,
  (SELECT min(k) FROM dd) AS day_min, (SELECT max(k) FROM dd) AS day_max, (SELECT count(*) FROM dd) AS n_days FROM f""", "flag_geo")
def a13(spark, sf):
    r = requests(spark, sf, "service", "geo").where(clean.contains_ci(F.col("service"), FLAG_WORD))
    return rounded(ro.bounding_box(r))


def _entropy(part: str, entropy: str, peak: str) -> str:
    return f"""SELECT service, round(-sum(p * ln(p)), 6) AS {entropy}, round(max(p), 6) AS {peak}
FROM (SELECT service, count(*) / sum(count(*)) OVER (PARTITION BY service) AS p FROM requests
  WHERE service IS NOT NULL AND {part} IS NOT NULL GROUP BY service, {part}) t GROUP BY service"""


@query("a14_month_entropy", _entropy("strftime(add_ts, '%Y-%m')", "month_entropy", "peak_month_share"), "requests")
def a14(spark, sf):
    r = requests(spark, sf, "service").withColumn("month", dates.month_text(F.col("add_ts")))
    return rounded(ro.entropy_and_peak(r, "service", "month", "month_entropy", "peak_month_share"))


@query("a15_ward_entropy", _entropy("ward", "ward_entropy", "top_ward_share"), "requests")
def a15(spark, sf):
    r = requests(spark, sf, "service", "ward")
    return rounded(ro.entropy_and_peak(r, "service", "ward", "ward_entropy", "top_ward_share"))


@query("a16_type_features", """
SELECT c.*, month_entropy, peak_month_share, ward_entropy, top_ward_share FROM (
  SELECT service, count(*) AS n_requests, round(avg(response_hours), 6) AS mean_rt, round(stddev_samp(response_hours), 6) AS std_rt,
    round(avg(overdue), 6) AS overdue_rate, round(avg(CASE WHEN date_part('isodow', add_ts) >= 6 THEN 1 ELSE 0 END), 6) AS weekend_share,
    round(median(response_hours), 6) AS median_rt, round(quantile_cont(response_hours, 0.9), 6) AS p90_rt,
    round(median(due_hours), 6) AS median_due, round(median(late_hours), 6) AS median_late_all,
    round(median(CASE WHEN overdue = 1 THEN late_hours END), 6) AS median_late_overdue,
    round(stddev_samp(response_hours) / nullif(avg(response_hours), 0), 6) AS rt_cv, round(ln(1 + count(*)), 6) AS log_n_requests
  FROM timed WHERE service IS NOT NULL GROUP BY service HAVING count(*) >= 50) c
LEFT JOIN me ON me.service = c.service LEFT JOIN we ON we.service = c.service""", "timed", "me", "we")
def a16(spark, sf):
    return rounded(ro.type_features(timed(spark, sf, "service", "ward"), min_support=50))


@query("a17_value_counts", """
SELECT c.service, c.n, s.n_categories, s.rare_share, s.n_null FROM (SELECT service, count(*) AS n FROM tagged WHERE service IS NOT NULL
  GROUP BY service ORDER BY n DESC, service LIMIT 20) c CROSS JOIN (SELECT count(*) AS n_categories, round(avg(CAST(n <= 10 AS INTEGER)), 6) AS rare_share,
  (SELECT count(*) FROM tagged WHERE service IS NULL) AS n_null
  FROM (SELECT service, count(*) AS n FROM tagged WHERE service IS NOT NULL GROUP BY service) t) s""", "tagged")
def a17(spark, sf):
    from frostline.runtime import scalars

    p = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 13 != 0, F.concat_ws(" ", "p_name", "p_brand")).alias("service"))
    null = p.where(F.col("service").isNull()).agg(F.count("*").alias("k")).scalar()
    top = ro.top_values(p, "service", 20).withColumn("_s", scalars(ro.rare_share(p, "service")))
    return rounded(top.select("service", "n", "_s.n_categories", "_s.rare_share").withColumn("n_null", null))


@query("a18_histogram", """
SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (tot * w), 6) AS density
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(80)) b CROSS JOIN lim
LEFT JOIN (SELECT CAST(least(floor((v - lo) / w), 79) AS BIGINT) AS bin, count(*) AS n FROM v, lim GROUP BY 1) c ON c.bin = b.bin""", "hist_lim")
def a18(spark, sf):
    t = timed(spark, sf)
    return rounded(ro.histogram(t, ro.log1p_nonnegative(F.col("response_hours")), 80, density=True))


_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_TXT = ["o_orderstatus", "o_orderpriority"]


def _profile_sql() -> str:
    parts = []
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderpriority", "string")):
        num = c in _NUM
        x = f"CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE {c} END" if c == "o_totalprice" else c
        stats = ", ".join(
            f"round(CAST({f} AS DOUBLE), 4) AS {a}" if num else f"CAST(NULL AS DOUBLE) AS {a}"
            for a, f in (("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("min", f"min({x})"),
                         ("q25", f"quantile_cont({x}, 0.25)"), ("q50", f"median({x})"),
                         ("q75", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")))
        distinct = f"count(DISTINCT {c})" if c in _TXT else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({x}) AS nulls, "
                     f"{distinct} AS \"distinct\", {stats} FROM orders")
    return " UNION ALL ".join(parts)


@query("a19_profile", _profile_sql())
def a19(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")
    return rounded(prof.profile(o), 4)


@query("a23_pivot", """
SELECT service, """ + ", ".join(f"count(*) FILTER (WHERE ward = 'Ward {i}') AS \"Ward {i}\"" for i in range(1, 9)) + """
FROM requests WHERE service IS NOT NULL GROUP BY service""", "requests")
def a23(spark, sf):
    r = requests(spark, sf, "service", "ward").select("service", "ward")
    return ro.zero_filled_pivot(r, "service", "ward", [f"Ward {i}" for i in range(1, 9)])


@query("a24_week_dow_matrix", """
SELECT *, round(max(greatest(mon, tue, wed, thu, fri, sat, sun)) OVER () * 1.1, 6) AS y_max FROM (
  SELECT date_part('week', add_ts) AS week, """ + ", ".join(
    f"count(*) FILTER (WHERE date_part('isodow', add_ts) = {i + 1}) AS {d}"
    for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])) + """, count(*) AS total
  FROM requests WHERE contains(service, 'widget') AND add_ts IS NOT NULL GROUP BY 1) t""", "requests")
def a24(spark, sf):
    r = requests(spark, sf, "service").where(clean.contains_ci(F.col("service"), FLAG_WORD))
    return rounded(ro.week_by_weekday(r))


@query("a26_fastest_services", """
SELECT service, round(avg(response_hours), 6) AS mean_rt FROM timed WHERE service IS NOT NULL GROUP BY service
HAVING avg(response_hours) IS NOT NULL ORDER BY avg(response_hours), service LIMIT 50""", "timed")
def a26(spark, sf):
    return rounded(ro.mean_response(timed(spark, sf, "service"), 50))


# --- ranking, samples, sets ---------------------------------------------------------

@query("w14_topn_per_ward", """
SELECT ward, service, n, rank, n_services FROM (SELECT ward, service, n, row_number() OVER (PARTITION BY ward ORDER BY n DESC, service) AS rank,
  count(*) OVER (PARTITION BY ward) AS n_services FROM (SELECT ward, service, count(*) AS n FROM requests
  WHERE ward IS NOT NULL AND service IS NOT NULL GROUP BY ward, service) c) t WHERE rank <= 50""", "requests")
def w14(spark, sf):
    return rounded(ro.services_per_ward(requests(spark, sf, "ward", "service"), 50))


@query("l1_topk", """
SELECT round_even(lat, 2) AS lat_bin, round_even(lon, 2) AS lon_bin, count(*) AS n FROM requests
WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""", "requests")
def l1(spark, sf):
    h = ro.hotspots(requests(spark, sf, "geo"), decimals=2)
    return topn.top_k(h, 20, F.desc("n"), F.col("lat_bin"), F.col("lon_bin"))


@query("l4_sample", """
SELECT o_orderkey AS request_id, round(o_totalprice, 6) AS price FROM orders
ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 3000""")
def l4(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_totalprice").alias("price"))
    return rounded(topn.sample_rows(o, 3000, ["request_id"]))


@query("l5_group_sample", """
SELECT o_orderpriority AS grp, o_orderkey AS request_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders) t WHERE rn <= 500""")
def l5(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("request_id"))
    return topn.sample_per_group(o, ["grp"], 500, ["request_id"])


@query("u1_union", """
SELECT kind, ward, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM (
  SELECT 'order' AS kind, ward, date FROM ward_orders UNION ALL
  SELECT 'request' AS kind, ward, CAST(add_ts AS DATE) AS date FROM requests) t GROUP BY kind, ward""", "ward_orders", "requests")
def u1(spark, sf):
    a = ward_orders(spark, sf).select(F.lit("order").alias("kind"), "ward", "date")
    b = requests(spark, sf, "ward").select(F.lit("request").alias("kind"), "ward", F.to_date("add_ts").alias("date"))
    return src.union_years([a, b]).groupBy("kind", "ward").agg(
        F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("u2_distinct", "SELECT DISTINCT service, ward FROM requests WHERE ward IS NOT NULL AND service IS NOT NULL", "requests")
def u2(spark, sf):
    return requests(spark, sf, "service", "ward").select("service", "ward").dropna().distinct().orderBy("service", "ward")
