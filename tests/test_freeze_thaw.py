"""Freeze-thaw cycles on small hand-made series and against a plain counter."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.operators import freeze_thaw as ft
from frostline.operators import weather as we

START = dt.datetime(2024, 1, 1)
FREEZE, THAW, NEUTRAL = -1.0, 5.0, 2.0


def hours(spark, temps, ward="Ward 1", start=START):
    rows = [(ward, start + dt.timedelta(hours=i), t, 0.0, 0.0) for i, t in enumerate(temps)]
    return spark.createDataFrame(
        rows, "ward string, ts timestamp, temperature_2m double, precipitation double, snowfall double")


def daily(spark, temps, **kw):
    return {r["date"]: r["ftc"] for r in ft.daily_ftc(hours(spark, temps, **kw)).collect()}


def count_runs(temps, min_hours=4, thaw=4.0):
    runs = []
    for t in temps:
        label = "N" if t is None or math.isnan(t) else "F" if t < 0 else "T" if t > thaw else "N"
        if runs and runs[-1][0] == label:
            runs[-1][1] += 1
        else:
            runs.append([label, 1])
    kept = [r[0] for r in runs if r[0] != "N" and r[1] >= min_hours]
    return sum(a == "F" and b == "T" for a, b in zip(kept, kept[1:]))


@pytest.mark.parametrize("temps, cycles", [
    ([FREEZE] * 4 + [THAW] * 4, 1),
    ([FREEZE] * 4 + [THAW] * 2 + [NEUTRAL] * 3 + [THAW] * 4, 1),
    ([FREEZE] * 4 + [NEUTRAL] * 3 + [FREEZE] * 4 + [THAW] * 4, 1),
    ([FREEZE] * 3 + [THAW] * 4, 0),
    ([FREEZE] * 4 + [4.0] * 4, 0),
    ([0.0] * 4 + [THAW] * 4, 0),
    ([FREEZE] * 2 + [float("nan")] + [FREEZE] * 2 + [THAW] * 4, 0),
    ([FREEZE] * 4 + [None] + [THAW] * 4, 1),
    ([THAW] * 4 + [FREEZE] * 4, 0),
])
def test_cycles(spark, temps, cycles):
    assert sum(daily(spark, temps).values()) == cycles == count_runs(temps)


def test_run_over_midnight_counts_on_the_day_it_ends(spark):
    temps = [FREEZE] * 22 + [THAW] * 5  # thaw 22:00 .. 02:00
    assert daily(spark, temps) == {dt.date(2024, 1, 2): 1}


def test_missing_hours_do_not_end_a_run(spark):
    h = hours(spark, [FREEZE] * 4 + [THAW] * 6).where(F.hour("ts") != 6)
    assert ft.count_cycles(h).collect()[0]["ftc"] == 1


def test_wards_do_not_mix(spark):
    h = hours(spark, [FREEZE] * 8).unionByName(hours(spark, [THAW] * 8, ward="Ward 2", start=START + dt.timedelta(hours=8)))
    assert {r["ward"]: r["ftc"] for r in ft.count_cycles(h).collect()} == {"Ward 1": 0, "Ward 2": 0}


def test_window_cuts_runs_at_its_edge(spark):
    # Freeze run of six hours around midnight: three hours lie inside the later window.
    temps = [NEUTRAL] * 21 + [FREEZE] * 6 + [THAW] * 6
    h = hours(spark, temps)
    target = START.date() + dt.timedelta(days=16)  # window starts on day 2
    targets = spark.createDataFrame([("Ward 1", target), ("Ward 1", target - dt.timedelta(days=1)),
                                     ("Ward 1", dt.date(2030, 1, 1))], "ward string, date date")
    got = {r["date"]: r["ftc_15d"] for r in ft.windowed_ftc(h, targets).collect()}
    assert got == {target: 0, target - dt.timedelta(days=1): 1, dt.date(2030, 1, 1): 0}
    assert sum(daily(spark, temps).values()) == 1


def test_no_hours_gives_zero(spark):
    empty = hours(spark, [1.0]).where("false")
    targets = spark.createDataFrame([("Ward 1", START.date())], "ward string, date date")
    assert [r["ftc_15d"] for r in ft.windowed_ftc(empty, targets).collect()] == [0]
    assert ft.daily_ftc(empty).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(blocks=st.lists(st.tuples(st.sampled_from([FREEZE, THAW, NEUTRAL, 0.0, 4.0]), st.integers(1, 7)), min_size=1, max_size=40))
def test_against_plain_counter(spark, blocks):
    temps = [t for t, n in blocks for _ in range(n)]
    assert sum(daily(spark, temps).values()) == count_runs(temps)


def test_windowed_against_plain_counter(spark):
    import random

    rnd = random.Random(7)
    temps = [t for _ in range(160) for t in [rnd.choice([FREEZE, THAW, NEUTRAL])] * rnd.randint(1, 9)]
    h = hours(spark, temps)
    days = [START.date() + dt.timedelta(days=i) for i in range(0, len(temps) // 24 + 17)]
    targets = spark.createDataFrame([("Ward 1", d) for d in days], "ward string, date date")
    got = {r["date"]: r["ftc_15d"] for r in ft.windowed_ftc(h, targets).collect()}
    stamps = [START + dt.timedelta(hours=i) for i in range(len(temps))]
    for d in days:
        hi = dt.datetime.combine(d, dt.time())
        inside = [t for s, t in zip(stamps, temps) if hi - dt.timedelta(days=15) <= s < hi]
        assert got[d] == count_runs(inside), d


def test_gap_days(spark):
    a = hours(spark, [1.0, 3.0])
    b = hours(spark, [5.0], start=START + dt.timedelta(days=2))
    got = {r["date"].day: r for r in we.daily_weather(a.unionByName(b)).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2]["tmax_c"] is None and got[2]["tmean_c"] is None and got[2]["precip_mm"] == 0.0
    assert got[1]["tmean_c"] == 2.0


def test_lookback_counts_days_before_the_target(spark):
    d = spark.createDataFrame([("Ward 1", dt.date(2024, 1, 1), 2.0), ("Ward 1", dt.date(2024, 1, 16), 4.0)],
                              "ward string, date date, precip_mm double")
    t = spark.createDataFrame([("Ward 1", dt.date(2024, 1, x)) for x in (1, 2, 16, 17)] + [("Ward 2", dt.date(2024, 1, 2))],
                              "ward string, date date")
    got = {(r["ward"][-1], r["date"].day): r["p"] for r in we.lookback_sum(d, t, "precip_mm", "p").collect()}
    assert got == {("1", 1): 0.0, ("1", 2): 2.0, ("1", 16): 2.0, ("1", 17): 4.0, ("2", 2): 0.0}
