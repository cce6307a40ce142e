"""The given tables in the roles the operators expect.

Each role is a plain query over the parquet tables. Joins are left joins from the fact
side to unique dimension keys, so a role only joins the dimensions a caller asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frostline.operators.timeseries import zero_filled_daily
from frostline.runtime import use_utc

SERIES_START, SERIES_END = "1995-01-01", "2001-08-01"
FLAG_WORD = "widget"
NO_WARD_NATION = 24
NO_ADDRESS_NATION = 23


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from a file footer once per path."""
    use_utc(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _ward(nation: str) -> F.Column:
    n = F.col(nation)
    return F.when(n != NO_WARD_NATION, F.concat(F.lit("Ward "), (n % 8 + 1).cast("string")))


def requests(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    """Service requests: one row per line item.

    ``need`` names the dimension-backed columns wanted: service, ward, geo, address.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
    out = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    grace = F.make_dt_interval((F.substring("o_orderpriority", 1, 1).cast("int") * 30))
    cols = [
        F.col("l_orderkey").alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("add_ts"),
        (F.col("o_orderdate").cast("timestamp") + grace).alias("due_ts"),
        F.when(F.col("l_linestatus") != "O", F.col("l_shipdate").cast("timestamp")).alias("resolved_ts"),
    ]
    if {"service", "address"} & set(need):
        p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        out = out.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
        cols.append(F.col("p_name").alias("service"))
    if {"ward", "geo", "address"} & set(need):
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
        out = out.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        cols.append(_ward("c_nationkey").alias("ward"))
    if "geo" in need:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
        out = out.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        cols += [
            (F.lit(38.8) + F.col("c_acctbal") / 100000).alias("lat"),
            (F.lit(-77.1) + F.col("s_acctbal") / 100000).alias("lon"),
        ]
    if "address" in need:
        unit = (
            F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" Apt "), F.col("c_nationkey").cast("string")))
            .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("  #"), F.col("c_nationkey").cast("string")))
            .otherwise(F.lit(""))
        )
        cols.append(
            F.when(
                F.col("c_nationkey") != NO_ADDRESS_NATION,
                F.concat((F.col("c_custkey") * 37).cast("string"), F.lit("  "), F.col("p_name"), unit),
            ).alias("address")
        )
    return out.select(*cols)


def ward_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, ward, date, price) per order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            _ward("c_nationkey").alias("ward"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("price"),
        )
    )


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ward, date, y): zero-filled orders per ward and day over the fixed calendar."""
    counts = (
        ward_orders(spark, sf_dir).where(F.col("ward").isNotNull())
        .groupBy("ward", "date").agg(F.count("*").alias("y"))
    )
    return zero_filled_daily(counts, "ward", SERIES_START, SERIES_END, "y")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of four stations, many hours missing (30 days from 2024-01-01)."""
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    )

    def amount(kind: str) -> F.Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)) / 10, 4)

    temp = F.lit(8) * F.sin(F.lit(2 * math.pi) * (F.hour("ts") + F.lit(0.37)) / 24) + (F.avg("value") - 50) / 10
    return (
        e.groupBy(F.concat(F.lit("Ward "), (F.col("user_id") % 4 + 1).cast("string")).alias("ward"), "ts")
        .agg(
            F.round(temp, 3).alias("temperature_2m"),
            amount("click").alias("precipitation"),
            amount("view").alias("snowfall"),
        )
    )


def long_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather over the whole order calendar: 24 hours per (ward, day with orders).

    Season and time of day give the shape, sums over the day's orders the noise; days
    without orders stay missing and one hour of some days has no precipitation value.
    """
    noise = (
        ward_orders(spark, sf_dir).where(F.col("ward").isNotNull())
        .groupBy("ward", "date").agg(F.sum("order_id").alias("k"))
    )
    h = noise.select("ward", "date", "k", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    two_pi = F.lit(2 * math.pi)
    temp = F.round(
        F.lit(8.0)
        + F.lit(12) * F.sin(two_pi * (F.dayofyear("date") - 110) / 365)
        + F.lit(5) * F.sin(two_pi * (F.col("h") - 9) / 24)
        + (F.col("k") % 17 - 8) / 2, 2)
    rain = (
        F.when((F.col("k") % 31 == 3) & (F.col("h") == 5), F.lit(None).cast("double"))
        .when((F.col("k") + F.col("h")) % 23 < 2, (F.col("k") % 11 + 1) / 10)
        .otherwise(F.lit(0.0))
    )
    return h.select(
        "ward",
        F.timestamp_seconds(F.unix_date("date").cast("bigint") * 86400 + F.col("h") * 3600).alias("ts"),
        temp.alias("temperature_2m"),
        rain.alias("precipitation"),
        F.when(temp < 0, F.coalesce(rain, F.lit(0.0)) / 2).otherwise(F.lit(0.0)).alias("snowfall"),
    )
