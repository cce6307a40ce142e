"""File layouts: station files, provenance records, request CSVs, sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from frostline.runtime import scratch_path
from frostline.sources import requests as rq
from frostline.sources import sinks, weather as we

STATION = """latitude,longitude,elevation,utc_offset_seconds,timezone,timezone_abbreviation
38.9,-77.0{i},54.0,-18000,America/New_York,GMT-5

time,precipitation_sum (mm),precipitation_hours (h),rain_sum (mm),showers_sum (mm),snowfall_sum (cm),temperature_2m_max (°C),temperature_2m_min (°C),relative_humidity_2m_max (%),relative_humidity_2m_min (%),relative_humidity_2m_mean (%)
2021-03-08,3.30,4.0,3.10,0.20,0.00,9.4,1.5,77,41,60
2021-03-09,0.00,0.0,0.00,0.00,0.00,11.2,,70,35,52
"""


def test_station_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"ward{i}-station.csv").write_text(STATION.format(i=i))
    rows = we.read_station_daily(spark, str(tmp_path)).orderBy("ward", "date").collect()
    assert len(rows) == 4
    assert (rows[0]["ward"], rows[0]["date"], rows[0]["tmax_c"], rows[0]["rh_mean"]) == ("Ward 1", dt.date(2021, 3, 8), 9.4, 60)
    assert rows[1]["tmin_c"] is None and rows[3]["longitude"] == -77.02 and rows[3]["utc_offset_seconds"] == -18000


def test_station_files_of_one_name_in_two_folders(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"y{i}").mkdir()
        (tmp_path / f"y{i}" / "ward1.csv").write_text(STATION.format(i=i))
    rows = we.read_station_daily(spark, str(tmp_path / "*")).collect()
    assert len(rows) == 4 and {r["longitude"] for r in rows} == {-77.01, -77.02}


def test_metadata_and_hourly_round_trip(spark, tmp_path):
    rec = {"label": "w1", "ward": "Ward 1", "variables": ["a", "b"], "latitude": 38.9, "start_date": "2022-12-01"}
    (tmp_path / "m.json").write_text(json.dumps(rec, indent=2))
    meta = we.read_metadata(spark, str(tmp_path / "m.json"))
    assert meta.first()["variables"] == ["a", "b"]
    h = spark.createDataFrame([("Ward 1", dt.datetime(2024, 1, 1, 5), 1.5, 0.0, None)],
                              "ward string, ts timestamp, temperature_2m double, precipitation double, snowfall double")
    out = scratch_path(spark, "saved")
    sinks.save_hourly(h, meta, out)
    back, info = sinks.load_hourly(spark, out)
    assert back.select("ward", "ts", "temperature_2m").first() == h.select("ward", "ts", "temperature_2m").first()
    assert info.first()["saved_at"] and info.first()["label"] == "w1"


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_hourly_by_suffix(spark, tmp_path, kind):
    path = str(tmp_path / f"hours.{kind}")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1.5, 0.0, 0.2)],
                               "date timestamp, temperature_2m double, precipitation double, snowfall double")
    (df.write.option("header", True).csv if kind == "csv" else df.write.parquet)(path)
    r = we.read_hourly(spark, path).first()
    assert (r["ts"], r["temperature_2m"], r["snowfall"]) == (dt.datetime(2024, 1, 1, 5), 1.5, 0.2)


def test_type_features_with_repeated_name(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("SERVICECODEDESCRIPTION,n_requests,cluster_kmeans,cluster_agg,n_requests,median_rt\nPothole,10,2,3,10,5.5\n")
    df = we.read_type_features(spark, str(p))
    assert df.columns == ["SERVICECODEDESCRIPTION", "n_requests", "cluster_kmeans", "cluster_agg", "n_requests_2", "median_rt"]
    assert tuple(df.first()) == ("Pothole", 10.0, 2.0, 3.0, 10.0, 5.5)


def test_request_csvs_of_two_years(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ServiceRequestId,AddDate,Ward,Latitude\n1,2023-01-05 10:00:00,Ward 1,38.9\n2,oops,,x\n")
    (tmp_path / "b.csv").write_text("SERVICEREQUESTID,CREATED_DATE,WARD_ID\n3,2022-02-01 00:00:00,Ward 2\n")
    u = rq.union_years([rq.read_requests(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv")])
    rows = {r["request_id"]: r for r in u.collect()}
    assert rows["1"]["add_ts"] == dt.datetime(2023, 1, 5, 10) and rows["1"]["lat"] == 38.9
    assert rows["2"]["add_ts"] is None and rows["2"]["lat"] is None and rows["2"]["ward"] is None
    assert rows["3"]["ward"] == "Ward 2" and rows["3"]["lat"] is None


def test_files_of_another_header_fail_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SERVICEREQUESTID,WARD\n1,Ward 1\n")
    (tmp_path / "b.csv").write_text("WARD,SERVICEREQUESTID\nWard 2,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        rq.read_requests(spark, str(tmp_path)).collect()


def test_ranked_results_and_metrics(spark):
    out = scratch_path(spark, "ranked")
    sinks.save_ranked(spark.createDataFrame([(3, 0.5), (1, 0.2), (2, 0.2)], "d int, val_mae double"), out, F.col("val_mae"), F.col("d"))
    assert [r["d"] for r in sinks.load_top(spark, out, 2, F.col("val_mae"), F.col("d")).collect()] == [1, 2]
    log = scratch_path(spark, "metrics")
    for stage in ("train", "test"):
        sinks.append_metrics(spark.createDataFrame([(1.0,)], "mae double"), log, "ridge", stage)
    assert spark.read.parquet(log).count() == 2
