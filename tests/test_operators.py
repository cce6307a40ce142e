"""Traps of the request operators on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import clean, dates
from frostline.models import metrics as mt
from frostline.operators import encoding, panel as pn, rollups as ro, splits as sp, stats, timeseries as ts, topn
from frostline.operators import quantiles
from frostline.operators.quantiles import aggregate
from frostline.sources import requests as src


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("garbage", "x", "nan"), ("2023-01-01 10:00:00", "38.9", "Ward 1"), (None, "nan", None)],
                               "a string, b string, w string")
    r = df.select(clean.to_ts(F.col("a")).alias("a"), clean.to_number(F.col("b")).alias("b"),
                  clean.null_text_wards(F.col("w")).alias("w")).collect()
    assert [tuple(x) for x in r] == [
        (None, None, None), (dt.datetime(2023, 1, 1, 10), 38.9, "Ward 1"), (None, None, None)]


def test_week_edge_keeps_calendar_year(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2022, 12, 31),)], "d date")
    got = {tuple(r) for r in df.select(F.year("d"), F.weekofyear("d")).collect()}
    assert got == {(2023, 52), (2022, 52)}


def test_half_even_bins(spark):
    df = spark.createDataFrame([(0.0025, 0.0035)], "lat double, lon double")
    r = ro.hotspots(df).first()
    assert (r["lat_bin"], r["lon_bin"]) == (0.002, 0.004)


def test_lateness_needs_both_dates(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(t, t + dt.timedelta(hours=5), t + dt.timedelta(hours=8)), (t, None, t + dt.timedelta(hours=1)),
         (t, t + dt.timedelta(hours=5), None), (t, t + dt.timedelta(hours=5), t + dt.timedelta(hours=5))],
        "add_ts timestamp, due_ts timestamp, resolved_ts timestamp")
    r = clean.with_lateness(df).select("overdue", "late_hours", "on_time").collect()
    assert [tuple(x) for x in r] == [(1, 3.0, 0), (0, 0.0, 0), (0, 0.0, 0), (0, 0.0, 1)]
    o = ro.overall_rates(clean.with_lateness(df)).first()
    assert (o["n"], o["n_both"], o["overdue_rate"], o["on_time_rate"]) == (4, 2, 0.25, 0.5)


def test_address_parts(spark):
    df = spark.createDataFrame([(" 12B  Main   St Apt 4 ",), ("no number",), ("77 Oak Ave",)], "a string")
    a = df.select(clean.clean_address(F.col("a")).alias("a"))
    got = [tuple(r) for r in a.select(*clean.address_parts(F.col("a")).values()).collect()]
    assert got == [("12B", "Main St", "Apt 4"), (None, None, None), ("77", "Oak Ave", None)]


def test_column_names_are_resolved_in_order(spark):
    df = spark.createDataFrame([(1, "a", "b")], ["service request id", " WardID", "Ward "])
    df = df.withColumnRenamed("service request id", "ServiceRequestId")
    c = src.canonical(df)
    assert c.first().asDict() == {"request_id": 1, "ward": "b"}


def test_missing_weekday_is_null_or_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 1),)], "add_ts timestamp")
    assert [r["n"] for r in ro.weekday_counts(df).orderBy("day_of_week").collect()] == [2] + [None] * 6
    assert [r["n"] for r in ro.weekday_counts(df, zero_fill=True).orderBy("day_of_week").collect()] == [2] + [0] * 6


def test_undated_rows_keep_their_bucket(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (dt.datetime(2024, 3, 2), None, 0)],
                               "add_ts timestamp, response_hours double, overdue int")
    got = {r["month"]: (r["n"], r["median_rt"]) for r in ro.monthly_summary(df).collect()}
    assert got == {"NaT": (1, 1.0), "2024-03": (1, None)}


@pytest.mark.parametrize("skewed", [False, True])
def test_quantiles_equal_numpy(spark, skewed):
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        g = None if i % 50 == 0 else "hot" if skewed and i % 3 else f"g{i % 7}"
        v = None if i % 11 == 0 else rnd.choice([0.0, rnd.expovariate(0.001), -rnd.random(), 1e9 * rnd.random()])
        rows.append((g, v, rnd.random()))
    rows += [("empty", None, 1.0), ("one", 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double, u double")
    wanted = {"q50": (F.col("v"), 0.5), "q90": (F.col("v"), 0.9), "q0": (F.col("v"), 0.0), "q1": (F.col("u"), 1.0)}
    for keys in (["g"], []):
        got = {tuple(r[k] for k in keys): r.asDict() for r in aggregate(df, keys, {"n": F.count("*")}, wanted).collect()}
        groups = {}
        for r in rows:
            groups.setdefault((r[0],) if keys else (), []).append(r)
        assert got.keys() == groups.keys()
        for k, members in groups.items():
            assert got[k]["n"] == len(members)
            for name, column, p in (("q50", 1, 0.5), ("q90", 1, 0.9), ("q0", 1, 0.0), ("q1", 2, 1.0)):
                values = [r[column] for r in members if r[column] is not None]
                want = float(np.quantile(values, p)) if values else None
                assert got[k][name] == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-9)), (k, name)


def test_quantiles_ignore_nan_and_outliers_move_no_cut(spark):
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert aggregate(nan, [], {}, {"q": (F.col("v"), 0.5)}).first()["q"] == 1.5
    far = spark.range(0, 20_000).selectExpr("IF(id = 7, 1e12, CAST(id AS DOUBLE)) AS v")
    got = aggregate(far, [], {}, {"q": (F.col("v"), 0.5), "r": (F.col("v"), 0.99)})
    values = [1e12 if i == 7 else float(i) for i in range(20_000)]
    assert (got.first()["q"], got.first()["r"]) == (pytest.approx(np.quantile(values, 0.5)), pytest.approx(np.quantile(values, 0.99)))


@pytest.mark.parametrize("fit, parts", [(500_000, 64), (40, 4), (3, 64), (1, 2)])
def test_quantiles_by_recursive_selection(spark, monkeypatch, fit, parts):
    """However few values fit a task, the result is exact and no sorted part holds more."""
    monkeypatch.setattr(quantiles, "FIT", fit)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rnd = random.Random(fit)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), 1e12, -1.5, float(rnd.randint(0, 30))]), rnd.random()) for g in ("a", None, "c") for _ in range(150)]
    df = spark.createDataFrame([*rows, ("none", None, 0.5)], "k string, v double, part double")
    wanted = {f"{c}{int(100 * p)}": (F.col(c), p) for c in ("v", "part") for p in (0.0, 0.1, 0.5, 0.99, 1.0)}
    got = {r["k"]: r for r in aggregate(df, ["k"], {}, wanted).collect()}
    for g in ("a", None, "c"):
        for name, (c, p) in wanted.items():
            values = [r[1 if name.startswith("v") else 2] for r in rows if r[0] == g]
            assert got[g][name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)
    assert got["none"]["v50"] is None and got["none"]["part50"] == 0.5
    whole = aggregate(df, [], {"n": F.count("*")}, {"q": (F.col("v"), 0.5)}).first()
    assert (whole["n"], whole["q"]) == (451, pytest.approx(np.quantile([r[1] for r in rows], 0.5)))


def test_null_predictions_do_not_count(spark):
    df = spark.createDataFrame([("a", 3.0, None), ("a", 2.0, 4.0), ("b", 1.0, None)], "m string, y_true double, y_pred double")
    got = {r["m"]: r for r in mt.metrics(df, ["m"]).collect()}
    assert (got["a"]["n"], got["a"]["mae"]) == (1, 2.0) and got["a"]["poisson_deviance"] == pytest.approx(2 * (2 * np.log(0.5) + 2))
    assert got["b"]["n"] == 0 and got["b"]["mae"] is None and got["b"]["poisson_deviance"] is None


def test_address_parts_with_control_characters(spark):
    rows = ["12 Main\u0001St", "x\u0001y\u0001z", "7 Oak Ave Apt 3", None, "\u0001"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in clean.address_parts(F.col("a")).items()]).collect()]
    assert got == [("12", "Main St", None), (None, None, None), ("7", "Oak Ave", "Apt 3"), (None, None, None), (None, None, None)]
    assert df.select(clean.clean_address(F.col("a")).alias("c")).collect()[0]["c"] == "12 Main St"


def test_codes_and_ranks_over_ranges(spark):
    rows = [(f"L{(7 * k) % 41:02d}", k % 5) for k in range(200)]
    got = {r["l"]: r["code"] for r in ro.first_seen_code(spark.createDataFrame(rows, "l string, t int"), "l", "t").collect()}
    first = {}
    for label, t in rows:
        first[label] = min(t, first.get(label, 99))
    want = {label: i for i, label in enumerate(sorted(first, key=lambda x: (first[x], x)))}
    assert got == want


def test_rolling_frames_need_all_values(spark):
    rows = [("a", i, None if i == 5 else float(i)) for i in range(10)] + [("b", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "ward string, date int, x double")
    w = ts.by_area()
    r = df.select("ward", "date", ts.lagged_sum(F.col("x"), w, 2, 1).alias("lag"), ts.forward_sum(F.col("x"), w, 2).alias("fwd"),
                  ts.centered_mean(F.col("x"), w, 3).alias("mid"), ts.trailing_mean(F.col("x"), w, 2).alias("tr"))
    got = {(x["ward"], x["date"]): x for x in r.collect()}
    assert got[("a", 3)]["lag"] == 3.0 and got[("a", 1)]["lag"] is None and got[("a", 6)]["lag"] is None
    assert got[("a", 7)]["fwd"] == 17.0 and got[("a", 3)]["fwd"] is None and got[("a", 8)]["fwd"] is None
    assert got[("a", 1)]["mid"] == 1.0 and got[("a", 0)]["mid"] is None
    assert got[("b", 0)]["tr"] is None and got[("b", 2)]["tr"] == 1.0


def test_panel_has_no_leak_between_wards(spark):
    start = dt.date(2024, 1, 1)
    rows = [(f"Ward {w}", start + dt.timedelta(weeks=i), float(100 * w + i), 1.0) for w in (1, 2) for i in range(12)]
    p = spark.createDataFrame(rows, "ward string, week date, y double, rain double")
    f = pn.panel_features(p, ["rain"])
    got = {(r["ward"], r["week"]): r for r in f.collect()}
    assert len(got) == 8
    first = got[("Ward 2", start + dt.timedelta(weeks=8))]
    assert (first["y_lag8"], first["y_roll8"], first["y_roll4"]) == (200.0, 203.5, 205.5)


def test_impute_uses_the_filled_column(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("b", None), ("c", 10.0)]
    df = spark.createDataFrame(rows, "ward string, x double")
    got = sorted((r["ward"], r["x"]) for r in pn.impute(df, ["x"]).collect())
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.5), ("b", 2.5), ("c", 10.0)]


def test_too_few_weeks_is_an_error(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(weeks=i)) for i in range(16)]
    with pytest.raises(Exception, match="not enough weeks"):
        pn.time_split(spark.createDataFrame(rows, "ward string, week date")).collect()


def test_expanding_folds(spark):
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(40)]
    df = spark.createDataFrame([(w,) for w in weeks], "week date")
    rows = pn.expanding_folds(df).collect()
    for fold, cut in zip((1, 2, 3), (24, 28, 32)):
        assert sorted(r["week"] for r in rows if r["fold"] == fold and r["role"] == "train") == weeks[:cut]
        assert sorted(r["week"] for r in rows if r["fold"] == fold and r["role"] == "valid") == weeks[cut:cut + 8]
    assert {r["fold"] for r in rows} == {1, 2, 3}
    assert pn.expanding_folds(df.limit(10)).count() == 0


def test_split_depends_on_the_date_only(spark):
    days = [(dt.date(2023, 1, 1) + dt.timedelta(days=i),) for i in range(365)]
    cal = spark.createDataFrame(days, "date date")
    full = {r["date"]: r["split"] for r in sp.make_split(cal, cal).collect()}
    part = {r["date"]: r["split"] for r in sp.make_split(cal.where(F.dayofyear("date") > 60), cal).collect()}
    assert all(full[d] == s for d, s in part.items())
    by_quarter = {}
    for d, s in full.items():
        by_quarter.setdefault((d.month - 1) // 3, []).append(s)
    for labels in by_quarter.values():
        n = len(labels)
        assert abs(labels.count("test") - 0.15 * n) <= 0.5 and abs(labels.count("val") - 0.15 * n) <= 0.5


def test_folds_are_balanced_inside_quarters(spark):
    days = spark.createDataFrame([(dt.date(2023, 1, 1) + dt.timedelta(days=i),) for i in range(365)], "date date")
    sizes = sp.fold_days(days, 5).groupBy("quarter").pivot("fold", list(range(5))).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in sizes)


def test_salted_top_n_equals_plain(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id"), F.xxhash64("id").alias("v"))
    order = [F.desc("v"), F.col("id")]
    a = topn.top_n_per_group(df, ["g"], 7, order)
    b = topn.top_n_per_group(df, ["g"], 7, order, salts=16, salt_by=["id"])
    assert sorted(a.collect()) == sorted(b.collect())
    s = topn.sample_per_group(df, ["g"], 40, ["id"]).groupBy("g").count().collect()
    assert {r["count"] for r in s} == {40}
    assert sorted(topn.sample_rows(df, 10, ["id"]).collect()) == sorted(topn.sample_rows(df.repartition(5), 10, ["id"]).collect())


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(5)], "ward string, x double, c double")
    m = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_matrix(df, ["x", "c"]).collect()}
    assert m[("x", "c")] is None and m[("x", "x")] == 1.0 and m[("c", "c")] is None
    assert [r["corr"] for r in stats.correlation_with(df, ["c"], "x").collect()] == [0.0]
    reg = stats.lag_regression(df.withColumnRenamed("x", "date"), "date", "c", 0, lags=1).first()
    assert (reg["r2"], reg["slope"], reg["corr"]) == (0.0, 0.0, 0.0)


def test_deviance_clips_predictions(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 2.0, 0.0)], "model string, y_true double, y_pred double")
    r = mt.metrics(df, ["model"]).first()
    want = (2 * (1e-8) + 2 * (2 * np.log(2 / 1e-8) - (2 - 1e-8))) / 2
    assert r["poisson_deviance"] == pytest.approx(want)


def test_safe_clip_and_health(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, -3.0, inf, float("nan"), -inf, None)], "p double")
    cap = float(np.quantile([1.0, 2.0, 0.0, 0.0], 0.995))
    assert sorted(r["p"] for r in mt.safe_clip(df, "p").collect()) == pytest.approx([0, 0, 1, cap, cap, cap, cap])
    assert [r["p"] for r in mt.safe_clip(df.where("p = double('infinity')"), "p").collect()] == [0.0]
    h = mt.health(df, "p").first()
    assert (h["n"], h["n_inf"]) == (7, 2) and h["finite_share"] == pytest.approx(3 / 7)


def test_encodings_follow_the_training_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("z", 9.0, 6.0)], "ward string, x double, c double")
    train = df.where("ward != 'z'")
    hot = encoding.one_hot(df, "ward", encoding.train_levels(train, "ward")).orderBy("ward").collect()
    assert [(r["ward_a"], r["ward_b"]) for r in hot] == [(1, 0), (0, 1), (0, 0)]
    s = encoding.standardize(df, ["x", "c"], train).orderBy("ward").collect()
    assert [(r["x"], r["c"]) for r in s] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 1.0)]


def test_entropy_forms_agree(spark):
    df = spark.createDataFrame([("s", m) for m in "aabbbbc"], "service string, month string")
    e = ro.entropy_and_peak(df, "service", "month", "e", "p").first()
    p = np.array([2, 4, 1]) / 7
    assert e["e"] == pytest.approx(-(p * np.log(p)).sum()) and e["p"] == pytest.approx(4 / 7)
    c = spark.createDataFrame([(2,), (4,), (1,), (0,)], "n int")
    assert c.agg(ro.entropy_from_counts(F.col("n"))).first()[0] == pytest.approx(e["e"])


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4 + [(None,)], "v double")
    assert [r["n"] for r in ro.histogram(df, F.col("v"), 3).orderBy("bin").collect()] == [4, 0, 0]


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),)], "d date")
    r = df.select(dates.week_start(F.col("d")).alias("w"), *[c.alias(n) for n, c in dates.dow_dummies(F.col("d")).items()]).first()
    assert r["w"] == dt.date(2024, 1, 1) and sum(r[1:]) == 0  # Sunday is the reference level
