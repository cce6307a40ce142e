"""Queries on correlations, lag regressions, metrics and prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.catalog.registry import query, rounded
from frostline.catalog.roles import daily_counts
from frostline.catalog.series import cols, daily_model, features, panel
from frostline.catalog.sql import block
from frostline.models import metrics as mt
from frostline.operators import panel as pn, rollups as ro, stats as st, timeseries as ts
from frostline.operators.topn import top_n_per_group
from frostline.plans import daily as pd_
from frostline.runtime import materialize

MODELS = {"naive7": 7, "naive28": 28}


def z(expr: str, name: str, digits: int = 6) -> str:
    """Rounded, with a value that rounds to zero written as plain zero."""
    return f"coalesce(nullif(round({expr}, {digits}), 0), CASE WHEN ({expr}) IS NOT NULL THEN 0.0 END) AS {name}"


# Predictions: trailing means of the daily counts as two naive models; the last 16 weeks
# of the calendar are valid / test as in the weekly split.
block("naive", """
SELECT ward, date, CAST(y AS DOUBLE) AS y, m.model, CASE WHEN date < DATE '2001-04-12' THEN 'train' WHEN date < DATE '2001-06-07' THEN 'valid' ELSE 'test' END AS split,
  CASE WHEN m.model = 'naive7' THEN p7 ELSE p28 END AS p FROM (
  SELECT ward, date, y,
    CASE WHEN count(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS p7,
    CASE WHEN count(y) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) = 28 THEN avg(y) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) END AS p28
  FROM daily_counts WINDOW w AS (PARTITION BY ward ORDER BY date)) t
CROSS JOIN (VALUES ('naive7'), ('naive28')) m(model) WHERE p28 IS NOT NULL
""", "daily_counts")

block("aligned", """
SELECT ward, date, model, split, y AS y_true, p AS y_pred, p - y AS err, abs(p - y) AS abs_err, abs(p - y) / (abs(y) + 1e-8) AS ape FROM naive
""", "naive")


def naive(spark, sf):
    w = ts.by_area()
    d = daily_counts(spark, sf)
    date = F.col("date")
    split = (F.when(date < F.lit("2001-04-12").cast("date"), "train")
             .when(date < F.lit("2001-06-07").cast("date"), "valid").otherwise("test"))
    means = d.select("ward", "date", F.col("y").cast("double").alias("y"), split.alias("split"),
                     *[ts.trailing_mean(F.col("y"), w, k).alias(m) for m, k in MODELS.items()])
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS]))
    return (means.where(F.col("naive28").isNotNull())
            .select("ward", "date", "y", "split", models.alias("x")).select("ward", "date", "y", "split", "x.*"))


def predictions(spark, sf):
    return mt.aligned(naive(spark, sf), "y", "p", F.col("model"), F.col("split")).drop("y", "p")


# --- series statistics --------------------------------------------------------------

@query("a20_dow_mean", """
SELECT ward, date_part('isodow', date) - 1 AS day_of_week, round(avg(y), 6) AS mean FROM daily_counts GROUP BY 1, 2""", "daily_counts")
def a20(spark, sf):
    d = daily_counts(spark, sf)
    return rounded(d.groupBy("ward", F.weekday("date").alias("day_of_week")).agg(F.avg("y").alias("mean")))


@query("a21_dispersion", """
SELECT ward, round(avg(y), 6) AS mean, round(var_samp(y), 6) AS variance, round(var_samp(y) / nullif(avg(y), 0), 6) AS dispersion
FROM daily_counts GROUP BY ward""", "daily_counts")
def a21(spark, sf):
    return rounded(st.dispersion(daily_counts(spark, sf), "y"))


@query("a22_ftc_stats", """
SELECT ward, ftc_15d, round(avg(pothole_count), 6) AS mean, round(stddev_samp(pothole_count), 6) AS std, count(pothole_count) AS n
FROM daily_feats GROUP BY 1, 2""", "daily_feats")
def a22(spark, sf):
    from frostline.catalog.roles import long_hourly

    return rounded(st.level_stats(pd_.daily_features(daily_counts(spark, sf), long_hourly(spark, sf)), "ftc_15d", "pothole_count"))


@query("a25_cv_summary", """
SELECT model, count(DISTINCT fold) AS folds, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std,
  round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std FROM (
  SELECT p.model, f.fold, avg(abs(p.y - p.yp)) AS mae, sqrt(avg((p.y - p.yp) * (p.y - p.yp))) AS rmse FROM (
    SELECT model, week, y, CASE WHEN model = 'roll4' THEN r4 ELSE r8 END AS yp FROM (
      SELECT ward, week, y, avg(y) OVER (PARTITION BY ward ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r4,
        avg(y) OVER (PARTITION BY ward ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS r8 FROM panel) t
    CROSS JOIN (VALUES ('roll4'), ('roll8')) m(model)) p
  JOIN weeks w ON w.week = p.week
  JOIN (SELECT CAST((c - 24) / 4 + 1 AS BIGINT) AS fold, c FROM (SELECT unnest(range(24, CAST((SELECT max(n) FROM weeks) AS BIGINT) - 8 + 1, 4)) AS c) a) f
    ON w.idx >= f.c AND w.idx < f.c + 8 GROUP BY 1, 2) q GROUP BY model""", "panel", "weeks")
def a25(spark, sf):
    p = panel(spark, sf)
    w = ts.by_area("ward", "week")
    means = p.select("week", F.col("y").alias("y_true"),
                     *[ts.trailing_mean(F.col("y"), w, k).alias(f"roll{k}") for k in (4, 8)])
    models = F.explode(F.array(*[F.struct(F.lit(f"roll{k}").alias("model"), F.col(f"roll{k}").alias("y_pred")) for k in (4, 8)]))
    pred = means.select("week", "y_true", models.alias("x")).select("week", "y_true", "x.*")
    valid = pn.expanding_folds(p).where(F.col("role") == "valid")
    by_fold = mt.metrics(pn.with_folds(pred, valid), ["model", "fold"])
    return rounded(mt.cv_summary(by_fold))


_CORR = ["pothole_count", "tmax_c", "tmin_c", "tmean_c", "precip_mm", "snow_cm"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT ward, '{a}' AS a, '{b}' AS b, " + (z(f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)", "corr") if a != b
                                                else f"CASE WHEN var_pop({a}) > 0 THEN 1.0 END AS corr")
    + " FROM daily_model GROUP BY ward" for a in _CORR for b in _CORR)


@query("m1_corr_matrix", _CORR_SQL, "daily_model")
def m1a(spark, sf):
    return rounded(st.correlation_matrix(daily_model(spark, sf), _CORR))


_FEATS = pd_.feature_columns()
_CT_SQL = " UNION ALL ".join(
    f"SELECT ward, '{c}' AS feature, coalesce(covar_pop(CAST({c} AS DOUBLE), CAST(Y AS DOUBLE)) / nullif(stddev_pop({c}) * stddev_pop(Y), 0), 0) AS corr FROM features GROUP BY ward"
    for c in _FEATS)


@query("m1_corr_target", f"""
SELECT ward, feature, {z('corr', 'corr', 5)} FROM (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY round(corr, 9) DESC, feature) AS rn
  FROM ({_CT_SQL}) t) q WHERE rn <= 10""", "features")
def m1b(spark, sf):
    c = st.correlation_with(features(spark, sf), _FEATS, "Y")
    return rounded(top_n_per_group(c, ["ward"], 10, [F.desc(F.round("corr", 9)), F.col("feature")]), 5)


block("lagcols", "SELECT ward, date, " + """CASE WHEN count(pothole_count) OVER (w ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) = 11
  THEN CAST(sum(pothole_count) OVER (w ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS DOUBLE) END AS yf, """
      + ", ".join(f"lag(precip_15d, {a}) OVER w AS p{a}" for a in range(10)) + ", "
      + ", ".join(f"CAST(lag(ftc_15d, {b}) OVER w AS DOUBLE) AS f{b}" for b in range(20))
      + " FROM daily_feats WINDOW w AS (PARTITION BY ward ORDER BY date)", "daily_feats")
_CELLS = " UNION ALL ".join(
    f"SELECT ward, {a} AS a, {b} AS b, yf AS y, p{a} AS p, f{b} AS f FROM lagcols" for a in range(10) for b in range(10))


@query("m2_lag_grid", f"""
SELECT ward, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, n, {z('''CASE WHEN yy <= 0 THEN 0.0
    WHEN pp * ff - pf * pf > 1e-12 * pp * ff THEN (py * py * ff - 2 * py * fy * pf + fy * fy * pp) / ((pp * ff - pf * pf) * yy)
    WHEN pp > 0 THEN py * py / (pp * yy) WHEN ff > 0 THEN fy * fy / (ff * yy) ELSE 0.0 END''', 'r2')} FROM (
  SELECT ward, a, b, count(*) AS n, var_pop(y) AS yy, var_pop(p) AS pp, var_pop(f) AS ff, covar_pop(p, f) AS pf, covar_pop(p, y) AS py, covar_pop(f, y) AS fy
  FROM ({_CELLS}) c WHERE y IS NOT NULL AND p IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2, 3) m""", "lagcols")
def m2(spark, sf):
    return rounded(st.lag_grid(_lag_input(spark, sf), "pothole_count", "precip_15d", "ftc_15d", 10))


def _lag_input(spark, sf):
    from frostline.catalog.roles import long_hourly

    d = pd_.daily_features(daily_counts(spark, sf), long_hourly(spark, sf))
    return d.select("ward", "date", "pothole_count", "precip_15d", "ftc_15d")


_ONE = " UNION ALL ".join(f"SELECT ward, {b} AS lag, yf AS y, f{b} AS x FROM lagcols" for b in range(20))


@query("m3_lag_ols", f"""
SELECT ward, CAST(lag AS BIGINT) AS lag, n, {z('my - coalesce(xy / nullif(xx, 0), 0) * mx', 'intercept')}, {z('coalesce(xy / nullif(xx, 0), 0)', 'slope')},
  {z('power(coalesce(xy / nullif(sqrt(xx) * sqrt(yy), 0), 0), 2)', 'r2')}, {z('coalesce(xy / nullif(sqrt(xx) * sqrt(yy), 0), 0)', 'corr')} FROM (
  SELECT ward, lag, count(*) AS n, avg(y) AS my, avg(x) AS mx, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(x, y) AS xy
  FROM ({_ONE}) c WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2) m""", "lagcols")
def m3(spark, sf):
    return rounded(st.lag_regression(_lag_input(spark, sf), "pothole_count", "ftc_15d", 10))


@query("m3_best_lag", f"""
SELECT ward, lag, n, r2 FROM (SELECT ward, CAST(lag AS BIGINT) AS lag, n, {z('r2', 'r2')}, row_number() OVER (PARTITION BY ward ORDER BY r2 DESC, lag) AS rn FROM (
  SELECT ward, lag, count(*) AS n, power(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 2) AS r2
  FROM ({_ONE}) c WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2) m) q WHERE rn = 1""", "lagcols")
def m3b(spark, sf):
    r = st.lag_regression(_lag_input(spark, sf), "pothole_count", "ftc_15d", 10)
    return rounded(st.best_lag(r).select("ward", "lag", "n", "r2"))


# --- predictions ----------------------------------------------------------------------

_DEV = "2 * avg(CASE WHEN y_true > 0 THEN y_true * ln(y_true / greatest(y_pred, 1e-8)) ELSE 0 END - (y_true - greatest(y_pred, 1e-8)))"


@query("m5_metrics", f"""
SELECT ward, model, split, count(*) AS n, round(avg(abs_err), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round({_DEV}, 6) AS poisson_deviance
FROM aligned GROUP BY 1, 2, 3""", "aligned")
def m5(spark, sf):
    return rounded(mt.metrics(predictions(spark, sf), ["ward", "model", "split"]))


@query("m6_aligned", f"""
SELECT ward, date, model, split, y_true, {', '.join(z(c, c) for c in ('y_pred', 'err', 'abs_err'))}, round(ape, 3) AS ape FROM aligned WHERE split <> 'train'""", "aligned")
def m6(spark, sf):
    p = predictions(spark, sf).where(F.col("split") != "train")
    return rounded(p.withColumn("ape", F.round("ape", 3)))


@query("m7_compare", """
SELECT model, split, count(*) AS n, round(avg(abs_err), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse,
  CASE model WHEN 'naive7' THEN 1 ELSE 2 END::BIGINT AS model_order, CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END::BIGINT AS split_order
FROM aligned GROUP BY 1, 2""", "aligned")
def m7(spark, sf):
    return rounded(mt.compare_models(predictions(spark, sf), list(MODELS), ["train", "valid", "test"])
                   .orderBy("model_order", "split_order"))


@query("m8_mean_baseline", """
SELECT n.ward, n.split, count(*) AS n, round(avg(abs(n.y - m.p)), 6) AS mae, round(sqrt(avg((n.y - m.p) * (n.y - m.p))), 6) AS rmse FROM naive n
JOIN (SELECT ward, avg(y) AS p FROM naive WHERE split = 'train' AND model = 'naive7' GROUP BY ward) m ON m.ward = n.ward
WHERE n.model = 'naive7' GROUP BY 1, 2""", "naive")
def m8(spark, sf):
    n = naive(spark, sf).where(F.col("model") == "naive7")
    p = mt.mean_baseline(n, "y", F.col("split") == "train")
    return rounded(mt.metrics(p, ["ward", "split"], "y").drop("poisson_deviance"))


@query("l2_worst_errors", f"""
SELECT ward, date, model, y_true, round(y_pred, 6) AS y_pred, round(abs_err, 6) AS abs_err FROM aligned
ORDER BY round(abs_err, 9) DESC, ward, date, model LIMIT 20""", "aligned")
def l2(spark, sf):
    p = predictions(spark, sf).withColumn("abs_err", F.round("abs_err", 9))
    return rounded(mt.worst_errors(p, 20, "ward", "date", "model").select("ward", "date", "model", "y_true", "y_pred", "abs_err"))


block("wild", """
SELECT ward, date, CASE WHEN date_part('doy', date) % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN date_part('doy', date) % 89 = 0 THEN CAST('nan' AS DOUBLE)
  WHEN date_part('doy', date) % 83 = 0 THEN -p WHEN date_part('doy', date) % 79 = 0 THEN CAST('-inf' AS DOUBLE) ELSE p END AS p FROM naive WHERE model = 'naive7'
""", "naive")


def wild(spark, sf):
    doy = F.dayofyear("date")
    return naive(spark, sf).where(F.col("model") == "naive7").select(
        "ward", "date", F.when(doy % 97 == 0, float("inf")).when(doy % 89 == 0, float("nan")).when(doy % 83 == 0, -F.col("p"))
        .when(doy % 79 == 0, float("-inf")).otherwise(F.col("p")).alias("p"))


@query("c25_safe_clip", f"""
SELECT ward, date, {z('least(coalesce(fin, cap), cap)', 'p')} FROM (SELECT *, CASE WHEN p = CAST('-inf' AS DOUBLE) THEN 0.0 WHEN isfinite(p) THEN greatest(p, 0.0) END AS fin FROM wild) w
CROSS JOIN (SELECT quantile_cont(CASE WHEN p = CAST('-inf' AS DOUBLE) THEN 0.0 WHEN isfinite(p) THEN greatest(p, 0.0) END, 0.995) AS cap FROM wild) c""", "wild")
def c25(spark, sf):
    return rounded(mt.safe_clip(wild(spark, sf), "p"))


@query("m20_pred_health", """
SELECT count(*) AS n, round(avg(CAST(isfinite(p) AS INTEGER)), 6) AS finite_share, count(*) FILTER (WHERE isinf(p)) AS n_inf,
  (SELECT string_agg(CAST(CAST(round(p * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY p DESC, ward, date) FROM (SELECT * FROM wild WHERE isfinite(p) ORDER BY p DESC, ward, date LIMIT 10) t) AS top10
FROM wild""", "wild")
def m20(spark, sf):
    from frostline.runtime import scalars

    w = wild(spark, sf)
    finite = w.where(~F.isnan("p") & (F.abs("p") != float("inf")))
    top = ro.top_k(finite, 10, F.desc("p"), F.col("ward"), F.col("date"))
    listed = top.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("k"), "ward", "date"))),
        lambda x: F.round(-x["k"] * 1000).cast("bigint").cast("string")), ",").alias("top10"))
    return rounded(mt.health(w, "p").withColumn("top10", listed.scalar()))
