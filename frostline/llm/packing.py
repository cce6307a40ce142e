"""Best-fit packing of documents into sequences by hierarchical residual packing.

Each partition cuts its documents into pieces of at most the capacity and best-fits the pieces
into bins. Bins that are (nearly) full are final. Underfull bins go up a tree: a node takes the bins
of several children as items of their fill, best-fits them again, emits what has become nearly
full and passes on the rest, until one node is left or a round no longer joins any bins. A round
hands an item over as (bin, fill), 16 bytes; as many nodes work as the number of items asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.shared import Run, texts
from frostline.llm.tokens import encoder

CAPACITY = 4096
SLACK = 0                 # a bin with at most this much room left is final
NODE_ITEMS = 500_000      # items of one tree node
LEAF_PIECES = 200_000     # pieces a leaf packs at once


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: bin and offset of each item, fill of each bin.

    The bins with each room left are a stack; a bit mask of the rooms in use gives the
    smallest one that suffices.
    """
    order = np.argsort(-sizes, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
            offset[i] = fill[b]
            fill[b] += size
        else:
            b, room = len(fill), capacity
            offset[i] = 0
            fill.append(size)
        where[i] = b
        left = room - size
        if left:
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(b)
    return where, offset, np.asarray(fill, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, at long, fill long"


def pack_leaves(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every text (null: empty) with their place in a bin of their partition."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        bins, held = TaskContext.get().partitionId() << 40, []

        def packed() -> pa.RecordBatch:
            nonlocal bins, held
            columns = [list(c) for c in zip(*held)]
            where, offset, fill = best_fit(np.asarray(columns[3], np.int64), capacity)
            columns += [where + bins, offset, fill[where]]
            bins, held = bins + len(fill), []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for doc, coded in encode.rows(batch):
                coded += end
                for k, a in enumerate(range(0, len(coded), 4 * capacity)):
                    ids = coded[a:a + 4 * capacity]
                    held.append((doc, k, a // 4, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None))
            if len(held) >= LEAF_PIECES:
                yield packed()
        if held:
            yield packed()

    return texts(docs).mapInArrow(leaf, PIECES)


def merge_tree(bins: DataFrame, run: Run, capacity: int = CAPACITY, slack: int = SLACK, node_items: int = NODE_ITEMS) -> DataFrame | None:
    """(bin, top, base): the bin that each underfull (bin, fill) ends in and its offset there."""
    moves, level = None, 0
    items = run.store(bins, "items0")
    count = items.count()
    while count > 1:
        nodes = -(-count // node_items)
        offset = level << 56

        def node(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["fill", "bin"], ascending=[False, True])
            where, base, fill = best_fit(rows["fill"].to_numpy(np.int64), capacity)
            first = rows["bin"].to_numpy()[np.unique(where, return_index=True)[1]]  # a merged bin keeps its first item's number
            return pd.DataFrame({"bin": rows["bin"], "to": first[where], "base": base, "fill": fill[where]})

        merged = run.store(
            items.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(offset)), F.lit(nodes)))
            .groupBy("node").applyInPandas(node, "bin long, to long, base long, fill long"), f"level{level}")
        step = merged.select("bin", "to", "base")
        if moves is None:
            moves = step.withColumnRenamed("to", "top")
        else:
            up = step.select(F.col("bin").alias("top"), "to", F.col("base").alias("more"))
            moves = run.store(moves.join(up, "top", "left").select(
                "bin", F.coalesce("to", "top").alias("top"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), f"moves{level}")
        level += 1
        items = merged.filter((F.col("bin") == F.col("to")) & (F.col("fill") < capacity - slack)).select("bin", "fill")
        left = merged.filter("bin = to").count()
        if nodes == 1 or left == count:
            break
        count = items.count()
    return moves


def pack(docs: DataFrame, run: Run, tokenizer: str, end_id: int, capacity: int = CAPACITY, slack: int = SLACK,
         keep_ids: bool = False, node_items: int = NODE_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Only documents longer than the capacity are cut; a whole piece of that length is a sequence of
    its own. Offsets of a sequence are gapless from 0. ``keep_ids`` keeps the ids of each piece
    (little-endian unsigned 32-bit) for ``sequences``. An empty table packs into no rows.
    """
    pieces = run.store(pack_leaves(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    underfull = pieces.filter(F.col("fill") < capacity - slack).groupBy("bin").agg(F.max("fill").alias("fill"))
    moves = merge_tree(underfull, run, capacity, slack, node_items)
    if moves is None:
        placed = pieces.withColumn("top", F.lit(None).cast("long")).withColumn("base", F.lit(None).cast("long"))
    else:
        placed = pieces.join(moves, "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids",
        F.coalesce("top", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a result packed with ``keep_ids``; a sequence is at most the capacity long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.expr("cast('' as binary)"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
