"""Token-id files of patched frame-of-reference blocks.

A segment holds whole documents. Its ids are cut into blocks of 128: each block stores its
minimum, a bit width that covers a chosen percentile of the offsets from it, the offsets
packed at that width, and in exception lists the position and the remaining high bits of
each offset that needs more. An index of block starts allows reading any range of ids
without unpacking what lies before it.

Layout of a segment (little-endian):
  magic ``PFR1``, u32 ids, u32 blocks, u32 exceptions
  u32 block minima, u8 widths, u8 exception counts
  u32 block starts (one more than blocks) in the packed area
  u8 exception positions, u32 exception high parts, packed area
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run, texts
from frostline.llm.tokens import encoder

BLOCK = 128
PERCENTILE = 0.90
SEGMENT_IDS = 1 << 18   # a segment is closed after the document that reaches this many ids
MAGIC = b"PFR1"
SEGMENTS = "shard int, first long, n_ids long, doc_ids array<bigint>, lengths array<int>, payload binary"


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value below 2**32."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head + np.zeros(2, "<u4").tobytes()
    grid = np.full(blocks * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    rank = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = bit_length(np.partition(rest, rank, axis=1)[:, rank])
    high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, at = np.nonzero(high)
    starts = np.zeros(blocks + 1, "<u4")
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=starts[1:])
    area = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.nonzero(width == w)[0]
        bits = (rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        area[starts[rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    return b"".join([
        head, np.uint32(len(row)).astype("<u4").tobytes(), least.astype("<u4").tobytes(), width.tobytes(),
        np.bincount(row, minlength=blocks).astype(np.uint8).tobytes(), starts.tobytes(),
        at.astype(np.uint8).tobytes(), high[row, at].astype("<u4").tobytes(), area.tobytes(),
    ])


def unpack(segment: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The ids from ``lo`` to ``hi`` (to the end); only the blocks that hold them are unpacked."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    n, blocks, extra = np.frombuffer(segment, "<u4", 3, 4).astype(int)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.empty(0, np.uint32)
    at = 16

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(segment, kind, count, at)
        at += found.nbytes
        return found

    least, width, counts = part("<u4", blocks), part("u1", blocks), part("u1", blocks)
    starts, places, highs = part("<u4", blocks + 1), part("u1", extra), part("<u4", extra)
    area = np.frombuffer(segment, "u1", int(starts[-1]), at)
    b0, b1 = lo // BLOCK, -(-hi // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), np.uint64)
    for w in np.unique(width[b0:b1]):
        if not w:
            continue
        rows = np.nonzero(width[b0:b1] == w)[0]
        packed = area[starts[b0 + rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = bits @ (np.uint64(1) << np.arange(w, dtype=np.uint64))
    ends = np.cumsum(counts, dtype=np.int64)
    e0, e1 = (ends[b0 - 1] if b0 else 0), ends[b1 - 1]
    if e1 > e0:
        row = np.repeat(np.arange(b1 - b0), counts[b0:b1])
        out[row, places[e0:e1]] |= highs[e0:e1].astype(np.uint64) << width[b0 + row].astype(np.uint64)
    out += least[b0:b1, None]
    return out.reshape(-1)[lo - b0 * BLOCK:hi - b0 * BLOCK].astype(np.uint32)


def write_ids(docs: DataFrame, run: Run, tokenizer: str, end_id: int, percentile: float = PERCENTILE,
              name: str = "segments") -> DataFrame:
    """Encode every text, append ``end_id`` and store segments in ascending order of doc_id.

    A range partition of doc_id is a shard, sorted by doc_id (equal ids by a hash of the
    text, nulls first); segments carry their first position within the shard. Null texts are empty
    texts. Spark's writer commits the segments, so a lost task leaves nothing behind.
    """
    schema = pa.schema([
        ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())), ("payload", pa.binary()),
    ])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        shard, first, ids, held = TaskContext.get().partitionId(), 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal first, ids, held
            flat = np.frombuffer(b"".join(held), "<u4")
            row = [[shard], [first], [len(flat)], [ids], [[len(x) // 4 for x in held]], [pack(flat, percentile)]]
            first, ids, held = first + len(flat), [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

        size = 0
        for batch in batches:
            for doc, coded in encode.rows(batch):
                coded += end
                ids.append(doc)
                held.append(coded)
                size += len(coded) // 4
                if size >= SEGMENT_IDS:
                    size = 0
                    yield close()
        if held:
            yield close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        texts(docs).repartitionByRange(parts, "doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    return run.store(ordered.mapInArrow(segments, SEGMENTS), name)


def read_ids(segments: DataFrame) -> DataFrame:
    """(shard, doc_id, place, ids) of every stored document: its place in the shard and its ids as
    little-endian unsigned 32-bit bytes. ``with_start`` turns the place into the overall one."""
    out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a segment at a time
                shard, first, doc_ids, lengths, payload = (c[i].as_py() for c in batch.columns)
                flat = unpack(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + starts),
                    pa.array([flat[4 * a:4 * b] for a, b in zip(starts, ends)], pa.binary()),
                ], schema=out)

    stored = segments.select("shard", "first", "doc_ids", "lengths", "payload")
    return stored.mapInArrow(documents, "shard int, doc_id long, place long, ids binary")


def shard_starts(segments: DataFrame) -> DataFrame:
    """(shard, before): ids in all earlier shards; as many rows as the writer had partitions."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))


def with_start(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``start``, the ids of all documents before, in place of ``shard`` and ``place``."""
    found = rows.join(shard_starts(segments), "shard")
    return found.withColumn("start", F.col("before") + F.col("place")).drop("shard", "place", "before")
