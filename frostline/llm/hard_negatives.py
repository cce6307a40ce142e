"""Hard negatives by exact integer inner products: Strassen tiles, then mergeable heaps.

Vectors become whole numbers, floor(256 x) of each component, and are laid out in tiles of up to ``TILE`` rows. Tiles of anchors
meet tiles of candidates, every pair of tiles in a group of its own; their scores are one matrix product by Strassen's
recursion on int64, with odd sides padded by zeros. Additions and products are exact modulo 2**64, so every score of 64 bits is;
tiles whose scores could be larger are multiplied with unbounded integers.

1. Positives: each pair of tiles keeps the first ``POSITIVES`` rows of the anchor's label per anchor, and the heaps of all tiles are
   merged.
2. Windows: each anchor goes back with its positives; a pair of tiles keeps the first ``NEGATIVES`` rows of other
   labels inside each positive's window, and these heaps are merged.

A heap is the first k rows by score, then smaller id; the first k of several heaps together are those of their
union, so they merge in any order, the first time inside the tasks before the shuffle.

Rows without id, label or vector, or with a null or non-finite component, take no part. A shorter vector counts as
filled up with zeros; no components at all score 0. Rows that repeat an id are rows of their own: each is an anchor if its id is, and may
be the other's positive. A scaled component or a score beyond 64 bits counts as the nearest 64-bit number. Other columns, whatever their
names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90, 100)     # low * positive <= base * negative <= high * positive
TILE = 2048                # rows of a tile
TILES = 4                  # candidate tiles of a slot, the unit that meets anchors
LEAF = 16                  # sides that Strassen no longer halves
CELLS = 1 << 22            # scores looked through at once
MOST = (1 << 63) - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven half-size products a level; odd sides get a row or column of zeros."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, p = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :p], b[:j, p:], b[j:, :p], b[j:, p:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * p), a.dtype)
    out[:i, :p] = m1 + m4 - m5 + m7
    out[:i, p:] = m3 + m5
    out[i:, :p] = m2 + m4
    out[i:, p:] = m1 - m2 + m3 + m6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 tiles."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    highest = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if width * highest[0] * highest[1] <= MOST:
        return strassen(a, np.ascontiguousarray(b.T))
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles as int64."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2.0 ** 62:
        return scaled.astype(np.int64)
    return np.array([max(-MOST, min(MOST, int(x) * SCALE if abs(x) >= 2.0 ** 53 else math.floor(x * SCALE))) for x in values.tolist()], np.int64)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in the least of 1, 2, 4 or 8 bytes that holds all of them, the size first."""
    for size in (1, 2, 4, 8):
        kind = np.iinfo(f"<i{size}")
        if not values.size or (values.min() >= kind.min and values.max() <= kind.max):
            return bytes([size]) + values.astype(f"<i{size}").tobytes()
    raise ValueError("int64 expected")


def unpack(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(rows, -1)


def tiles(vectors: DataFrame, slots: int, tile: int = TILE) -> DataFrame:
    """(slot, rows, row, id, label, numbers, counts, asked): rows (row, id, label, vec, asked) of a partition, packed; ``slot`` is its number."""
    names = ["slot", "rows", "row", "id", "label", "numbers", "counts", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                lengths = part.column(3).value_lengths().to_numpy()
                full = np.zeros((len(lengths), int(lengths.max())), np.int64)
                full[np.arange(full.shape[1]) < lengths[:, None]] = whole_numbers(part.column(3).flatten().to_numpy(zero_copy_only=False))
                counts = part.column(4).value_lengths().to_numpy().astype(np.int64)
                packed = [part.column(k).to_numpy().tobytes() for k in range(3)] + [pack(full), counts.tobytes(), part.column(4).flatten().to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([len(lengths)], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names=names)

    rows = vectors.select("row", "id", "label", "vec", "asked").repartition(slots)
    return rows.mapInArrow(run, "slot int, rows int, " + ", ".join(f"{c} binary" for c in names[2:]))


class Tile:
    """Rows of several packed tiles, in the order of ids; ``asked`` holds a row's numbers in turn."""

    def __init__(self, packed: pd.DataFrame):
        def flat(name: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, np.int64) for x in packed[name]])

        parts = [unpack(x, n) for x, n in zip(packed["numbers"], packed["rows"])]
        width = max(p.shape[1] for p in parts)
        numbers = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
        row, ids, label, counts, asked = (flat(c) for c in ("row", "id", "label", "counts", "asked"))
        order = np.lexsort((row, ids))
        self.numbers, self.row, self.id, self.label = numbers[order], row[order], ids[order], label[order]
        by_row = np.split(asked, np.cumsum(counts)[:-1])
        self.line = np.repeat(np.arange(len(row)), counts[order])
        self.asked = np.concatenate([by_row[k] for k in order])
        self.place = np.concatenate([np.arange(len(by_row[k])) for k in order])


def heaps(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the first k allowed columns of each line by score, then column."""
    none = np.int64(-MOST - 1)
    held = np.where(allowed, score, none)
    n = held.shape[1]
    if k < n:
        bound = np.partition(held, n - k, axis=1)[:, n - k]
        line, column = np.nonzero((held >= bound[:, None]) & allowed)
    else:
        line, column = np.nonzero(allowed)
    order = np.lexsort((column, ~score[line, column], line))
    line, column = line[order], column[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < k], column[place < k]


def meet(left: DataFrame, right: DataFrame, left_slots: int, right_slots: int, compare: Callable, schema: str) -> DataFrame:
    """``compare`` over every pair of an anchor slot and a candidate slot, each pair a group."""
    def everywhere(df: DataFrame, own: str, other: str, n: int) -> DataFrame:
        return df.withColumnRenamed("slot", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    a = everywhere(left, "a", "c", right_slots).groupBy("a", "c")
    return a.cogroup(everywhere(right, "c", "a", left_slots).groupBy("a", "c")).applyInPandas(compare, schema)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    vec = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(finite)


def merged(found: DataFrame, line: list[str], k: int, *order: Column) -> DataFrame:
    """The first k of all heaps of a line; each task cuts its own before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*line).orderBy(*order))).filter(F.col("rank") <= k)


def found_in(columns: list[str], parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame(columns=columns).astype("int64")
    return pd.DataFrame(dict(zip(columns, (np.concatenate(x) for x in zip(*parts)))))


def first_positives(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """(anchor, anchor_id, id, row, score): per anchor the heap of rows of its label."""
    parts = []
    if len(left) and len(right):
        a, c = Tile(left), Tile(right)
        step = max(1, CELLS // len(c.id))
        for at in range(0, len(a.id), step):
            s = scores(a.numbers[at:at + step], c.numbers)
            line, column = heaps(s, (a.label[at:at + step, None] == c.label) & (a.row[at:at + step, None] != c.row), k)
            parts.append((a.row[at + line], a.id[at + line], c.id[column], c.row[column], s[line, column]))
    return found_in(["anchor", "anchor_id", "id", "row", "score"], parts)


def first_negatives(left: pd.DataFrame, right: pd.DataFrame, k: int, window: tuple[int, int, int]) -> pd.DataFrame:
    """(anchor, place, id, row, score): per anchor and positive score asked for the heap of other labels inside the window."""
    parts, (low, high, base) = [], window
    if len(left) and len(right):
        a, c = Tile(left), Tile(right)
        # the window in whole scores, by unbounded integers; a positive below 0 leaves none
        least = np.array([max(-MOST, -(-low * s // base)) for s in a.asked.tolist()], np.int64)
        most = np.array([min(MOST, high * s // base) for s in a.asked.tolist()], np.int64)
        step = max(1, CELLS // len(c.id))
        for at in range(0, len(a.id), step):
            s = scores(a.numbers[at:at + step], c.numbers)
            other = a.label[at:at + step, None] != c.label
            begin, end = np.searchsorted(a.line, [at, at + step])
            for b in range(begin, end, step):
                e = min(end, b + step)
                here = a.line[b:e] - at
                held = s[here]
                line, column = heaps(held, other[here] & (held >= least[b:e, None]) & (held <= most[b:e, None]), k)
                parts.append((a.row[a.line[b + line]], a.place[b + line], c.id[column], c.row[column], held[line, column]))
    return found_in(["anchor", "place", "id", "row", "score"], parts)


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Callable[[Column], Column], run: Run, id_col: str = "vec_id", vec_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int, int] = WINDOW, tile: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives."""
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    rows = run.store(usable(vectors, id_col, vec_col, label).withColumn("row", F.monotonically_increasing_id()), "rows")
    chosen = run.store(rows.filter(is_anchor(F.col("id"))), "anchor-rows")
    nothing = F.array().cast("array<long>")
    a_slots, c_slots = max(1, -(-chosen.count() // tile)), max(1, -(-rows.count() // (tile * TILES)))
    candidates = run.store(tiles(rows.withColumn("asked", nothing), c_slots, tile), "candidates")
    anchors = tiles(chosen.withColumn("asked", nothing), a_slots, tile)
    found = meet(anchors, candidates, a_slots, c_slots, lambda a, c: first_positives(a, c, positives), "anchor long, anchor_id long, id long, row long, score long")
    first = run.store(merged(found, ["anchor"], positives, *order), "positives")

    asked = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("asked"))  # a few an anchor
    again = tiles(chosen.join(asked, F.col("row") == F.col("anchor")), a_slots, tile)
    found = meet(again, candidates, a_slots, c_slots, lambda a, c: first_negatives(a, c, negatives, window), "anchor long, place long, id long, row long, score long")
    held = merged(found, ["anchor", "place"], negatives, *order)
    pairs = first.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return held.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
