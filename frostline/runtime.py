"""Session helpers: time zone, checkpoint folder, scalar attachment, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def use_utc(spark: SparkSession) -> SparkSession:
    """Wall-clock timestamps are read as UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scalars(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct column (a scalar subquery, not a join)."""
    return stats.select(F.struct("*").alias("s")).scalar()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    For tables that several later plans read: cuts the lineage, keeps column pruning, and
    the rows survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no later reader needs."""
    for df in stored:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Append the 0-based position of each row of ``df`` in ascending ``order`` without one task seeing all rows.

    Rows are range-partitioned; each range numbers its own rows and adds the rows of the
    ranges before it. Rows that tie in ``order`` must not exist.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (
        dealt.join(sizes.select("_range", before.alias("_before")), "_range")
        .withColumn(name, here + F.col("_before")).drop("_range", "_before")
    )
