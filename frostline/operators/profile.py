"""Table profile: one row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators.quantiles import aggregate
from frostline.runtime import scalars


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """distinct_<column> in one row: (column, value) pairs are reduced together, then counted."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("p"))
    each = pairs.select("p.c", "p.v").where(F.col("v").isNotNull()).distinct().groupBy("c").agg(F.count("*").alias("n"))
    return each.agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("n"))), F.lit(0)).alias(f"distinct_{c}") for i, c in enumerate(columns)])


def profile(df: DataFrame) -> DataFrame:
    """Rows, nulls, type per column; distinct values of text, describe() of numeric columns.

    Plain statistics come from a single pass; quartiles and distinct counts have their own
    distributed plans and meet the rest as one-row scalars.
    """
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    one_pass = df.agg(F.count("*").alias("rows"), *[
        f(c).alias(f"{a}_{c}")
        for names, stats in (
            ([x.name for x in fields], {"count": F.count}),
            (numeric, {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}),
        ) for c in names for a, f in stats.items()
    ])
    quart = aggregate(df, [], {}, {
        f"q{p}_{c}": (F.col(c), p / 100) for c in numeric for p in (25, 50, 75)}) if numeric else None
    base = one_pass.withColumns({
        **({"_q": scalars(quart)} if quart is not None else {}),
        **({"_d": scalars(distinct_values(df, text))} if text else {}),
    })

    def cell(f: T.StructField):
        c, num = f.name, f.name in numeric

        def stat(a, where=""):
            return (F.col(f"{where}{a}_{c}").cast("double") if num else F.lit(None).cast("double"))

        return F.struct(
            F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("rows"),
            (F.col("rows") - F.col(f"count_{c}")).alias("nulls"),
            (F.col(f"_d.distinct_{c}") if c in text else F.lit(None).cast("bigint")).alias("distinct"),
            stat("mean").alias("mean"), stat("std").alias("std"), stat("min").alias("min"),
            stat("q25", "_q.").alias("q25"), stat("q50", "_q.").alias("q50"), stat("q75", "_q.").alias("q75"),
            stat("max").alias("max"))

    return base.select(F.explode(F.array(*[cell(f) for f in fields])).alias("r")).select("r.*")
