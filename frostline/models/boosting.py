"""Boosted regression trees for counts (Poisson objective) from histograms.

Features are binned once by their quantile cuts. A round grows one tree per model, level by level: tasks add up
gradients (mu - y) and hessians (mu) by (model, node, feature, bin), the sums of all tasks meet under (model, node),
and the best split of every node comes back. A leaf is -sum g / (sum h + l2), the Newton step, times
the rate. Any number of models (folds, cut-offs) grow in the same jobs; a row lies in storage once and
names the models it trains. Rows that fit one block of ``ROWS`` hold all sums of their models, so the levels of several rounds
need no exchange and the models are dealt to tasks; the trees are the same either way.

The running score of each row and model is the only state. It is kept with the binned rows between rounds and
written to the checkpoint folder every few rounds, so a lost executor repeats at most these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.runtime import ensure_checkpoint_dir, materialize, release

BINS = 64                  # of a feature
ROWS = 100_000             # rows of a block, the unit of a task's work
STORE_EVERY = 25           # rounds between two checkpoints
LEAST_HESSIAN = 1.0        # of a child
TREE = ("feature", "split", "value", "gain")
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class BoostedCounts:
    """Trees as arrays (round, node) in heap order: node k has the children 2k + 1 and 2k + 2. ``feature`` is -1 at a
    leaf; a row goes left if its bin is at most ``split``. Missing values lie in the last bin."""

    features: list[str]
    rate: float
    base: float
    cuts: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def importances(self) -> dict[str, float]:
        """Share of the total gain per feature, summed over the trees."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], weights=self.gain[inner], minlength=len(self.features))
        return dict(zip(self.features, (total / (total.sum() or 1.0)).tolist()))

    def means(self, x: np.ndarray) -> np.ndarray:
        """Predicted means of rows of feature values."""
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.base)
        for feature, split, value in zip(self.feature, self.split, self.value):
            total += self.rate * value[descend(bins, feature, split)]
        return np.exp(np.minimum(total, 30.0))

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        return predict_each([self], df, F.lit(0), name)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cuts below it; missing values count as the largest."""
    return np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def descend(bins: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        right = bins[rows, np.maximum(f, 0)] > split[node]
        node = np.where(inner, 2 * node + 1 + right, node)


def values(features: list[str]) -> Column:
    """The features of a row as doubles, missing ones as NaN."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).cast("array<double>")


def predict_each(models: list[BoostedCounts], df: DataFrame, which: Column, name: str = "y_pred") -> DataFrame:
    """Append the mean that the model numbered ``which`` predicts for the row."""
    @F.pandas_udf("double")
    def score(x: pd.Series, model: pd.Series) -> pd.Series:
        rows, number = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0)), model.to_numpy()
        out = np.full(len(rows), np.nan)
        for k in np.unique(number[~pd.isna(number)]).astype(int):
            out[number == k] = models[k].means(rows[number == k])
        return pd.Series(out)

    return df.withColumn(name, score(values(models[0].features), which.cast("int")))


def quantile_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct cuts of every feature, from one aggregation of quantile summaries."""
    shares = F.lit([k / bins for k in range(1, bins)])
    one = F.lit(10_000)
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, one).alias(f"c{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array(c or [], float)) for c in row]


def blocks(df: DataFrame, cuts: list[np.ndarray], models: int, rows: int = ROWS) -> DataFrame:
    """Rows (x, y, h, trains) as blocks of bytes: bins, targets, hashes and the models that each row trains."""
    names = ["bins", "y", "h", "trains"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
            trains = np.zeros((n, models), bool)
            trains[np.repeat(np.arange(n), batch.column(3).value_lengths().to_numpy()), batch.column(3).flatten().to_numpy()] = True
            parts.append((binned(x, cuts), batch.column(1).to_numpy(), batch.column(2).to_numpy(), trains))
            held += n
            if held >= rows:
                yield whole(parts)
                parts, held = [], 0
        if parts:
            yield whole(parts)

    def whole(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*parts)], names=names)

    return df.mapInArrow(run, ", ".join(f"{c} binary" for c in names))


class Block:
    """Binned rows of a task with the scores of its models."""

    def __init__(self, row, features: int, models: int, own: np.ndarray):
        self.y = np.frombuffer(row["y"], np.float64)
        self.h = np.frombuffer(row["h"], np.int64).view(np.uint64)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(len(self.y), features)
        self.trains = np.frombuffer(row["trains"], bool).reshape(len(self.y), models)[:, own].T.copy()
        self.own = own
        self.score = np.zeros((len(own), len(self.y)))

    def totals(self) -> list[tuple]:
        return [(int(m), np.array([self.y[t].sum(), t.sum()])) for m, t in zip(self.own, self.trains)]

    def started(self, base: np.ndarray) -> Block:
        self.score = np.repeat(base[self.own][:, None], len(self.y), axis=1)
        return self

    def advanced(self, forest: Forest, rate: float) -> Block:
        for k, m in enumerate(self.own):
            self.score[k] += rate * forest.value[m][descend(self.bins, forest.feature[m], forest.split[m])]
        return self

    def histograms(self, forest: Forest, level: int, start: np.ndarray, draw: tuple[int, float]) -> Iterator[tuple]:
        """((model, node), sums of gradient and hessian by bin of all features) of the nodes of a level."""
        seed, share = draw
        drawn = np.ones(len(self.y), bool)
        if share < 1:
            mixed = (self.h ^ np.uint64(seed * int(_M) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            drawn = (mixed ^ (mixed >> np.uint64(31))) * _M < np.uint64(int(share * 2.0 ** 64))
        first, total = (1 << level) - 1, int(start[-1])
        codes = self.bins + start[:-1]
        for k, m in enumerate(self.own):
            rows = np.nonzero(self.trains[k] & drawn)[0]
            node = descend(self.bins[rows], forest.feature[m], forest.split[m])
            here = (node >= first) & forest.open[m][node]
            rows, node = rows[here], node[here] - first
            if not len(rows):
                continue
            mu = np.exp(np.minimum(self.score[k, rows], 30.0))
            place = (node[:, None] * total + codes[rows]).ravel()
            width = codes.shape[1]
            sums = [np.bincount(place, np.repeat(w, width), (first + 1) * total).reshape(first + 1, total) for w in (mu - self.y[rows], mu)]
            for found in np.unique(node):
                yield (int(m), int(first + found)), np.stack([sums[0][found], sums[1][found]])


class Forest:
    """The trees that grow in one round, one per model."""

    def __init__(self, models: int, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature, self.split = np.full((models, size), -1, np.int16), np.zeros((models, size), np.int16)
        self.value, self.gain = np.zeros((models, size)), np.zeros((models, size))
        self.open = np.zeros((models, size), bool)
        self.open[:, 0] = True

    def grow(self, found: list[tuple], l2: float) -> bool:
        """Take the splits of a level; false once no node is open."""
        self.open[:] = False
        for m, node, feature, split, gain, left, right in found:
            if node == 0:
                self.value[m, 0] = leaf(left + right, l2)
            if feature < 0:
                continue
            self.feature[m, node], self.split[m, node], self.gain[m, node] = feature, split, gain
            for child, sums in ((2 * node + 1, left), (2 * node + 2, right)):
                self.value[m, child] = leaf(sums, l2)
                self.open[m, child] = True
        return bool(self.open.any())


def leaf(sums: np.ndarray, l2: float) -> float:
    """The Newton step of rows with these sums of gradient and hessian."""
    return float(-sums[0] / max(sums[1] + l2, 1e-12))


def best_split(key: tuple[int, int], sums: np.ndarray, start: np.ndarray, columns: np.ndarray, l2: float) -> tuple:
    """(model, node, feature, bin, gain, sums left, sums right); feature -1 if no split gains."""
    feature = np.repeat(np.arange(len(start) - 1), np.diff(start))
    inside = np.cumsum(sums, axis=1)
    before = np.concatenate([np.zeros((2, 1)), inside], axis=1)[:, start[:-1]]
    left = inside - before[:, feature]
    whole = sums[:, :start[1]].sum(axis=1)
    right = whole[:, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
    allowed = (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN) & columns[feature]
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    if not gain[at] > 1e-9:
        return *key, -1, 0, 0.0, whole, np.zeros(2)
    return *key, int(feature[at]), int(at - start[feature[at]]), float(gain[at]), left[:, at], right[:, at]


def fit_many(df: DataFrame, features: list[str], target: str, trains: Column, models: int, rounds: int = 300, rate: float = 0.05, depth: int = 6,
             row_share: float = 1.0, column_share: float = 1.0, key: list[str] | None = None, seed: int = 42, l2: float = 1.0, bins: int = BINS) -> list[BoostedCounts]:
    """The models 0 to ``models`` - 1, all in the same jobs; ``trains`` is the array of those that a row trains.

    ``key`` names the columns that identify a row; row samples are drawn by its hash, the same for every model. Rows
    without target train nothing. A model without rows predicts a mean of 0.
    """
    if not features:
        raise ValueError("trees need a feature")
    sc = df.sparkSession.sparkContext
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(target).isNotNull()).select(
        values(features).alias("x"), F.col(target).cast("double").alias("y"), F.xxhash64(*(key or [*features, target])).alias("h"), trains.cast("array<int>").alias("trains"))
    cuts = quantile_cuts(df, features, bins)
    start = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
    parts = max(1, -(-rows.count() // ROWS))
    stored = materialize(blocks(rows.repartition(parts), cuts, models), "boost-blocks")

    groups = max(1, min(models, sc.defaultParallelism // parts))  # few blocks: a block's models are dealt to several tasks
    dealt = [np.arange(models)[g::groups] for g in range(groups)]
    width, several, read = len(features), stored.count() > 1, stored.rdd
    tasks = read.getNumPartitions() * groups

    def spread(part: int, found: Iterator) -> list[tuple[int, Block]]:
        return [(part * groups + g, Block(row, width, models, own)) for row in found for g, own in enumerate(dealt)]

    state = read.mapPartitionsWithIndex(spread).partitionBy(tasks, lambda k: k).values()
    sums = dict(state.flatMap(Block.totals).reduceByKey(lambda a, b: a + b, 1).collect())  # two numbers a model
    mean = np.array([sums[m][0] / sums[m][1] if m in sums and sums[m][1] else 0.0 for m in range(models)])
    base = np.log(np.maximum(mean, 1e-9))
    state = kept(state.map(lambda b: b.started(base)))
    rng = np.random.default_rng(seed)
    plans = []
    for r in range(rounds):
        columns = np.zeros(width, bool)
        columns[rng.choice(width, max(1, round(column_share * width)), replace=False)] = True
        plans.append((columns, (seed * 100_003 + r, row_share)))
    forests, old, size = [], [], (models, depth)
    for at in range(0, rounds, STORE_EVERY):
        batch = plans[at:at + STORE_EVERY]
        if several:
            for columns, draw in batch:
                forest = Forest(*size)
                for level in range(depth):
                    found = state.flatMap(histogram_step(forest, level, start, draw)).reduceByKey(np.add, tasks)
                    if not forest.grow(found.map(split_step(start, columns, l2)).collect(), l2):  # a few numbers a node
                        break
                forests.append(forest)
                for done in old:
                    done.unpersist()
                old = [state]
                state = kept(state.map(advance_step(forest, rate)), len(forests) % STORE_EVERY == 0)
        else:  # each model has all its rows in one block, so its sums meet nobody else's
            grown = kept(state.map(rounds_step(batch, size, start, rate, l2)), True)
            forests += merged([f for f in grown.map(lambda found: found[1]).collect()], size, len(batch))
            for done in old:
                done.unpersist()
            old = [state, grown]
            state = grown.map(lambda found: found[0])
    for done in (*old, state):
        done.unpersist()
    release(stored)
    return [
        BoostedCounts(list(features), rate, float(base[m]), cuts, *(np.stack([getattr(f, a)[m] for f in forests]) for a in TREE))
        for m in range(models)
    ]


def merged(parts: list[list[tuple]], size: tuple[int, int], rounds: int) -> list[Forest]:
    """The forests of a batch of rounds from those of the tasks, each of its own models."""
    out = [Forest(*size) for _ in range(rounds)]
    for part in parts:
        for whole, (own, *arrays) in zip(out, part):
            for name, values in zip(TREE, arrays):
                getattr(whole, name)[own] = values
    return out


def kept(state: RDD, checkpoint: bool = False) -> RDD:
    state.persist(StorageLevel.MEMORY_AND_DISK)
    if checkpoint:
        state.checkpoint()
    return state


def histogram_step(forest: Forest, level: int, start: np.ndarray, draw: tuple[int, float]):
    return lambda block: block.histograms(forest, level, start, draw)


def split_step(start: np.ndarray, columns: np.ndarray, l2: float):
    return lambda found: best_split(found[0], found[1], start, columns, l2)


def rounds_step(batch: list[tuple], size: tuple[int, int], start: np.ndarray, rate: float, l2: float):
    def step(block: Block) -> tuple[Block, list[tuple]]:
        found = []
        for columns, draw in batch:
            forest = Forest(*size)
            for level in range(size[1]):
                if not forest.grow([best_split(*node, start, columns, l2) for node in block.histograms(forest, level, start, draw)], l2):
                    break
            block = block.advanced(forest, rate)
            found.append((block.own, *(getattr(forest, name)[block.own] for name in TREE)))
        return block, found

    return step


def advance_step(forest: Forest, rate: float):
    return lambda block: block.advanced(forest, rate)


def fit_boosted_counts(df: DataFrame, features: list[str], target: str, **options) -> BoostedCounts:
    """One model on all rows; ``options`` as in ``fit_many``."""
    return fit_many(df, features, target, F.array(F.lit(0)), 1, **options)[0]


def importance_table(spark, model: BoostedCounts) -> DataFrame:
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double")


def save_boosted(spark, model: BoostedCounts, path: str) -> None:
    """A row per tree, next to a one-row table of the settings."""
    spark.createDataFrame(
        [(i, *(a.tolist() for a in row)) for i, row in enumerate(zip(model.feature, model.split, model.value, model.gain))],
        "round int, feature array<int>, split array<int>, value array<double>, gain array<double>",
    ).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame(
        [(model.features, model.rate, model.base, [c.tolist() for c in model.cuts])],
        "features array<string>, rate double, base double, cuts array<array<double>>",
    ).write.mode("overwrite").parquet(f"{path}/settings")


def load_boosted(spark, path: str) -> BoostedCounts:
    s = spark.read.parquet(f"{path}/settings").first()
    trees = spark.read.parquet(f"{path}/trees").orderBy("round").collect()  # rounds x nodes, whatever the rows were
    arrays = (np.array([t[a] for t in trees], kind) for a, kind in (("feature", np.int16), ("split", np.int16), ("value", float), ("gain", float)))
    return BoostedCounts(list(s["features"]), s["rate"], s["base"], [np.array(c, float) for c in s["cuts"]], *arrays)
