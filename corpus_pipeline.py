"""A training-corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage works on all that its predecessor kept and its decisions take effect. Every stage but the
last returns the columns of ``documents``, whatever they are; columns whose names a stage itself would use are
left alone. Null texts count as empty. An empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import crf_quality, jaccard, packing, toxicity
from frostline.llm.catalog import END_ID, WORD_BPE
from frostline.llm.labelled import fold
from frostline.llm.shared import Run, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    name = f"quality_{uuid.uuid4().hex}"
    field = crf_quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return crf_quality.score(docs, field, name).filter(F.col(name) >= crf_quality.THRESHOLD).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    name = f"toxicity_{uuid.uuid4().hex}"
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the least doc_id.

    A document is a doc_id with a text: of equal rows of both one stays, by a hash of the other columns; rows of one doc_id with
    different texts are judged apart. A row without a doc_id comes after all named ones of its group. Texts without words are
    near nothing but themselves.
    """
    key, columns = f"document_{uuid.uuid4().hex}", [docs[c] for c in docs.columns]
    keyed = docs.select(*columns, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias(key))
    groups = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), Run(spark, "near-duplicates"))
    named = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id")).distinct()
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("least")
    first = named.join(groups.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key").groupBy("component_id").agg(least)
    kept = keyed.join(first.select(F.col("least.key").alias(key)), key, "left_semi")
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
    return kept.groupBy(key).agg(one).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document."""
    return packing.pack(docs, Run(spark, "packing"), public_tokenizers.path(WORD_BPE), END_ID).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("best-fit packing", pack),
]

# SQL expresses neither the two classifiers nor the tokenizer; the tests hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again by the next."""
    stored, docs = Run(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored.store(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
