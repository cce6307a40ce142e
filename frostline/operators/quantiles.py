"""Exact interpolated quantiles per group, by recursive selection.

Distinct values of every group are counted and stored once. A group of more than ``FIT`` distinct values is cut at
approximate quantiles of them, rows are counted between the cuts, and only the parts that hold a wanted rank are
kept; those are cut again until each fits, and then sorted. All ranks of all groups go through the same rounds, a round
leaves about one in ``PARTS`` of the values, and no task sorts more than ``FIT``. Cuts follow the values' ranks, not their
size, so an outlier moves no cut. The result is exact wherever the cuts fall. NaN counts as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.runtime import materialize, release, scalars

FIT = 500_000           # distinct values that one task sorts
PARTS = 64              # parts of a group that does not fit
ACCURACY = 4096         # the approximate quantiles' rank error is a 4096th of the distinct values


def aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, Column],
    quantiles: dict[str, tuple[Column, float]],
) -> DataFrame:
    """``groupBy(keys)`` with ordinary aggregates plus exact quantiles of expressions.

    ``quantiles`` maps an output name to (expression, p); null and NaN values are ignored and
    a group without values gives null.
    """
    found = _ranked(df, keys, quantiles)
    if not keys:
        row = scalars(found)
        return df.agg(*[c.alias(n) for n, c in aggs.items()] or [F.count("*").alias("_n")]).withColumn(
            "_q", row).select(*aggs, *[F.col(f"_q.{n}").alias(n) for n in quantiles])
    base = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*keys).distinct()
    renamed = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return base.join(renamed, same, "left").select(*keys, *aggs, *quantiles)


def _by_expression(quantiles: dict[str, tuple[Column, float]]) -> dict[str, tuple[Column, list[float]]]:
    """The distinct expressions, each with all the quantiles wanted of it."""
    out: dict[str, tuple[Column, list[float]]] = {}
    for c, p in quantiles.values():
        ps = out.setdefault(str(c), (c, []))[1]
        if p not in ps:
            ps.append(p)
    return out


def _ranked(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[Column, float]]) -> DataFrame:
    wanted = _by_expression(quantiles)
    slot = {e: i for i, e in enumerate(wanted)}
    values = F.array(*[F.struct(F.lit(i).alias("m"), c.cast("double").alias("v")) for i, (c, _) in enumerate(wanted.values())])
    long = df.select(*keys, F.explode(values).alias("q")).where(F.col("q.v").isNotNull() & ~F.isnan("q.v"))
    # one key for group and expression; null keys are equal inside a struct
    counts = long.groupBy(F.struct(*keys, "q.m").alias("k"), F.col("q.v").alias("v")).agg(F.count("*").alias("n"))
    stored = materialize(counts, "value-counts")

    ps = F.element_at(F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for _, ps in wanted.values()]), F.col("k.m") + 1)
    places = (
        stored.groupBy("k").agg(F.sum("n").alias("total")).select("k", "total", F.explode(ps).alias("p"))
        .withColumn("pos", F.col("p") * (F.col("total") - 1)).select("k", "p", "pos", F.floor("pos").alias("r0"), F.ceil("pos").alias("r1"))
    )
    ranks = places.select("k", F.explode(F.array("r0", "r1")).alias("rank")).distinct()
    found = _selected(stored.select("k", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before"), "v", "n"), ranks)
    low, high = (found.select("k", F.col("rank").alias(r), F.col("v").alias(v)) for r, v in (("r0", "v0"), ("r1", "v1")))
    at = places.join(low, ["k", "r0"]).join(high, ["k", "r1"]).withColumn("q", F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("r0")))
    return at.groupBy(*[F.col(f"k.{k}").alias(k) for k in keys]).agg(
        *[F.max(F.when((F.col("k.m") == slot[str(c)]) & (F.col("p") == float(p)), F.col("q"))).alias(n) for n, (c, p) in quantiles.items()])


def _selected(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(k, rank, v): the value at each 0-based rank (k, rank) among ``values`` (k, part, before, v, n), where parts of a
    group k follow each other and ``before`` rows lie in front of a part."""
    stored = None
    while not (large := values.groupBy("k", "part").count().where(F.col("count") > FIT).select("k", "part")).isEmpty():
        narrower = materialize(_cut(values, large, ranks), "quantile-parts")
        if stored is not None:
            release(stored)
        values = stored = narrower
    through = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ends = values.withColumn("upto", F.col("before") + F.sum("n").over(through))
    return ends.join(ranks, "k").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("k", "rank", "v")


def _cut(values: DataFrame, large: DataFrame, ranks: DataFrame) -> DataFrame:
    """``values`` with the parts (k, part) of ``large`` cut in ``PARTS``, without parts that hold no rank."""
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = (
        values.join(large, ["k", "part"], "left_semi")
        .groupBy("k", "part").agg(F.percentile_approx("v", shares, ACCURACY).alias("cuts"))
    )
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("v"))), F.lit(0))
    placed = values.join(cuts, ["k", "part"], "left").withColumn("place", F.when(F.col("cuts").isNull(), 0).otherwise(below)).drop("cuts")
    rows = placed.groupBy("k", "part", "before", "place").agg(F.sum("n").alias("rows"))
    front = Window.partitionBy("k", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("rows").over(front), F.lit(0)))
    held = (
        starts.join(ranks, "k").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("rows")))
        .select("k", "part", "place", "start").distinct()
    )
    return placed.drop("before").join(held, ["k", "part", "place"]).select(
        "k", (F.col("part") * PARTS + F.col("place")).alias("part"), F.col("start").alias("before"), "v", "n")
