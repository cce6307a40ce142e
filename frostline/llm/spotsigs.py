"""Spot signatures: chains of content words behind common words, as document fingerprints.

A spot is a common word (the anchor) and the next content words of the text; the set of a
text's spots is its fingerprint. Navigation and lists hold few common words and so leave few
spots; running prose leaves many. Sets are compared by Jaccard similarity, and sets whose lengths alone rule
a threshold out are told apart by their length partition. Everything here is SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import texts

# Common words of the four languages that open a spot.
ANCHORS = """
a an and in is of that the to was
das der die ein eine ist und von zu
de des du est et la le les un une
con el en es los que se y
""".split()
# Further common words, which neither open nor join a chain.
STOPWORDS = """
are as at be been but by for from had has have he her his i it its not on or she they this were which with you
als am auf aus bei bin dem den er es für ich im mit nach nicht sich sie sind so wie wir
au aux avec ce dans elle en il ils je mais nous ont ou par pas pour qui sa se ses son sur vous
al como del las lo más no o para pero por su sus una
""".split()
CHAIN = 2
EVERY = 8                # one content word in so many opens a spot as well
MARK = "\u0001"          # joins anchors to the word behind them; no word holds it


def with_spots(rows: DataFrame, text: str, name: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``name``: the sorted distinct 32-bit spots of column ``text``, as longs.

    Words whose hash is divisible by ``EVERY`` open a spot as common words do, so texts poor in
    common words are told apart too. A text with words but without spots is one spot of its own; a text
    without words has none. Each step is a column, so no step is computed twice.
    """
    others = "|".join(sorted(set(STOPWORDS) - set(ANCHORS)))
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    content = F.trim(F.regexp_replace("_words", rf"(?<![^ ])(?:{others})(?: +|$)", ""))
    marked = F.regexp_replace(content, rf"(?<![^ ])({'|'.join(ANCHORS)})(?: +|$)", f"$1{MARK}")
    links = F.arrays_zip(F.col("_units").alias("u"), F.col("_plain").alias("w0"), *[
        F.when(F.size("_plain") > k, F.slice("_plain", k + 1, F.size("_plain"))).otherwise(F.array().cast("array<string>")).alias(f"w{k}")
        for k in range(1, chain)
    ])
    opens = lambda r: F.contains(r["u"], F.lit(MARK)) | (F.pmod(F.xxhash64(r["w0"]), F.lit(EVERY)) == 0)
    short = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = F.transform(F.filter(links, opens), lambda r: short(F.xxhash64(r["u"], *[r[f"w{k}"] for k in range(1, chain)])))
    whole = F.when(F.col("_words") == "", F.array().cast("array<bigint>")).otherwise(F.array(short(F.xxhash64("_words"))))
    return (
        rows.withColumn("_words", words).withColumn("_units", F.split(marked, " +"))
        .withColumn("_plain", F.transform("_units", lambda u: F.substring_index(u, MARK, -1)))
        .withColumn("_hashed", hashed)
        .withColumn(name, F.when((F.size("_hashed") > 0) & (F.col("_words") != ""), F.array_sort(F.array_distinct("_hashed"))).otherwise(whole))
        .drop("_words", "_units", "_plain", "_hashed")
    )


def fingerprint(found: Column) -> Column:
    """Eight hexadecimal digits for each spot, in ascending order; empty if there are none."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two spot sets; two empty sets are alike, an empty and another are not."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / (F.size(a) + F.size(b) - common))


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of similarity ``threshold`` or more are in one partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold)))


def pruned_likeness(a: Column, b: Column, threshold: float) -> Column:
    """Similarity, or null where length partitions or lengths show that it is below ``threshold``."""
    apart = F.abs(length_partition(F.size(a), threshold) - length_partition(F.size(b), threshold)) > 1
    short = F.least(F.size(a), F.size(b)) < F.lit(threshold) * F.greatest(F.size(a), F.size(b))
    return F.when(~apart & ~short, likeness(a, b))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, spots, next_text, next_spots): each text with the next one in descending doc_id.

    The last row's next is the first row. Null ids come last; rows of one id are ordered by text.
    Ids are dealt to ``buckets`` ranges by approximate quantiles; each range also gets a copy of
    the first row of the range after it, so one shuffle by range suffices and no task sees all rows.
    """
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    share = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = sorted(set(rows.select(F.percentile_approx("doc_id", share, 10_000)).first()[0] or []))
    limits = F.array(*map(F.lit, cuts)).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(limits, lambda c: c <= F.col("doc_id"))))
    dealt = rows.withColumn("bucket", bucket)
    heads = sorted(((b, i) for b, i in dealt.groupBy("bucket").agg(F.max("doc_id")).collect()), reverse=True)  # a row per range
    before = {i: heads[k - 1][0] for k, (_, i) in enumerate(heads)}  # the first range's head follows the last range
    named = [i for i in before if i is not None]
    target = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for i in named for x in (i, before[i])]), F.col("doc_id")) if named else F.lit(None).cast("int"),
        F.lit(before.get(None)).cast("int"))
    wanted = F.col("doc_id").isin(named) if named else F.lit(False)
    if None in before:
        wanted = wanted | F.col("doc_id").isNull()
    ghosts = (
        rows.filter(wanted).groupBy("doc_id").agg(F.max(F.struct("h", "text")).alias("top"))
        .select("doc_id", "top.text", "top.h", target.alias("bucket"), F.lit(1).alias("copy"))
    )
    together = with_spots(dealt.withColumn("copy", F.lit(0)).unionByName(ghosts).repartition(buckets, "bucket"), "text", "spots")
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.desc("text"))
    return (
        together.withColumn("next_text", F.lead("text").over(order)).withColumn("next_spots", F.lead("spots").over(order))
        .filter("copy = 0").select("doc_id", "text", "spots", "next_text", "next_spots")
    )


def edited_fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of every text (null: empty) and of its edited text, with their likeness.

    The edited text has the last half of its code points (rounded down) replaced by the first as many, or
    all, of the next document. A table of one row is its own next document; an empty table
    gives no rows.
    """
    size = F.length("text").cast("long")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)"))
    rows = with_next(docs, buckets).withColumn("n_chars", size).withColumn("half", half).withColumn("edited", edited)
    return (
        with_spots(rows, "edited", "edited_spots").select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("spots")).alias("fingerprint"),
            fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
            likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
            likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))
    )
