"""Token counts of documents in flat token files without an index.

A flat file is a run of unsigned 32-bit ids in which an end id closes every document. It is read in
blocks of fixed length that know nothing of documents. Each block is searched for the end id in
one vectorised pass, which also leaves a one-row summary: separators found and ids behind the
last one. A prefix scan over the summaries of a file gives every block the number of the document
it begins in and where that document began, so each separator's document gets its number,
start and length without looking at another block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run, texts
from frostline.llm.tokens import encoder, forget

BLOCK_IDS = 1 << 15
ROW_GROUP = 4 << 20
BLOCKS = "file string, block long, ids binary"


def blocks_of_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids) of flat files below ``path``: little-endian unsigned 32-bit ids, nothing else."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                for b in range(-(-content.size // (4 * block_ids))):
                    part = content.slice(4 * block_ids * b, min(4 * block_ids, content.size - 4 * block_ids * b)).to_pybytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([b], pa.int64()), pa.array([part], pa.binary())], names=["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, BLOCKS)


def write_flat(docs: DataFrame, run: Run, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode every text, close it with ``end_id`` and store flat token files in blocks, one file per
    partition; beside them (file, document, doc_id) names the documents in the order of each file.

    Strings of special tokens in a text are ordinary text, so ``end_id`` only ever ends a document.
    Null texts are empty texts: a lone end id. Rows of one doc_id are documents of their own.
    """
    names = ["file", "block", "ids", "document", "doc_id"]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, literal_specials=True), np.uint32(end_id).astype("<u4").tobytes()
        file, block, document, held = f"part-{TaskContext.get().partitionId():05d}", 0, 0, bytearray()
        none = lambda kind: pa.nulls(1, kind)
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([file] * n), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]),
                pa.array(range(document, document + n), kinds[3]), batch.column(0),
            ], names=names)
            document += n
            for _, coded in encode.rows(batch):
                held += coded + end
                while len(held) >= 4 * block_ids:
                    part = bytes(held[:4 * block_ids])
                    del held[:4 * block_ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([block], kinds[1]), pa.array([part], kinds[2]), none(kinds[3]), none(kinds[4])], names=names)
                    block += 1
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], kinds[1]), pa.array([bytes(held)], kinds[2]), none(kinds[3]), none(kinds[4])], names=names)

    stored = run.store(texts(docs).mapInArrow(flat, BLOCKS + ", document long, doc_id long"), "flat", ROW_GROUP)
    return (
        stored.filter("block IS NOT NULL").select("file", "block", "ids"),
        stored.filter("block IS NULL").select("file", "document", "doc_id"),
    )


def scan(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, block, n_ids, at): positions of the end id within each block."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[i].as_py(), "<u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()),
                    pa.array([np.nonzero(ids == end_id)[0]], pa.list_(pa.int64())),
                ], names=["file", "block", "n_ids", "at"])

    return blocks.mapInArrow(search, "file string, block long, n_ids long, at array<bigint>")


def document_counts(blocks: DataFrame, run: Run, end_id: int) -> DataFrame:
    """(file, document, start, n_tokens) of every document that an end id closes, that id included.

    Ids behind a file's last end id belong to a document that was never closed and are reported
    as one more document, so no id is lost; empty files have none. Only block summaries meet in a
    window: one short row for every ``BLOCK_IDS`` ids of a file.
    """
    found = run.store(scan(blocks, end_id), "separators")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", "n_ids", F.size("at").cast("long").alias("n"), F.try_element_at("at", F.lit(-1)).alias("last"))
    carried = (
        summary.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("document", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("opened", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
        .withColumn("final", F.lead("block").over(in_file).isNull())
        .select("file", "block", "base", "document", "opened", "final")
    )
    ends = F.transform("at", lambda x: F.col("base") + x + 1)
    behind = F.col("base") + F.col("n_ids")
    last_end = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("opened"))
    # the tail of the file's last block, if its document was never closed
    closed = F.when(F.col("final") & (last_end < behind), F.concat("ends", F.array(behind))).otherwise(F.col("ends"))
    return (
        found.join(carried, ["file", "block"]).withColumn("ends", ends).withColumn("ends", closed)
        .select("file", "document", "opened", "ends", F.posexplode("ends").alias("k", "end"))
        .withColumn("start", F.when(F.col("k") == 0, F.col("opened")).otherwise(F.get("ends", F.col("k") - 1)))
        .select("file", (F.col("document") + F.col("k")).alias("document"), "start", (F.col("end") - F.col("start")).alias("n_tokens"))
    )
