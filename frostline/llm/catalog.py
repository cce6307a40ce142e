"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import (
    bpe, collocations, crf_quality, hard_negatives, jaccard, packing, pfor, posting_lists, separator_scan, spotsigs, style_tree, substring_dedup, toxicity,
)
from frostline.llm.labelled import fold
from frostline.llm.shared import Run, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 1               # the contracts' end of document
END_OF_TEXT = 49407      # the word vocabulary's own end of text, which no ordinary text holds


def classified(scored: DataFrame, held_out, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return classified(toxicity.score_texts(docs, model), held_out, toxicity.THRESHOLD)


def op2_patched_frame_of_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = pfor.write_ids(table(spark, sf_dir, "documents"), Run(spark, "op2"), public_tokenizers.path(WORD_BPE), END_ID)
    read = pfor.read_ids(segments).select(
        "shard", "doc_id", "place", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return pfor.with_start(read, segments).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    field = crf_quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return classified(crf_quality.score_texts(docs, field), held_out, crf_quality.THRESHOLD)


def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(spark, "op5")
    blocks, order = separator_scan.write_flat(table(spark, sf_dir, "documents"), run, public_tokenizers.path(WORD_BPE), END_OF_TEXT)
    counts = separator_scan.document_counts(blocks, run, END_OF_TEXT)
    return counts.join(order, ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens")


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"), buckets)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"), Run(spark, "op7"))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), Run(spark, "op8"), public_tokenizers.path(WORD_BPE), END_ID)
    return placed.drop("ids")


def op9_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return posting_lists.nearest(vectors, lambda vec_id: F.pmod(vec_id, F.lit(100)) == 0, Run(spark, "op9"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), Run(spark, "op10"))


def op11_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.repeats(table(spark, sf_dir, "documents"), Run(spark, "op11"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, label, lambda vec_id: vec_id % 100 == 0, Run(spark, "op12"))


def op13_branch_and_bound_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents"), Run(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity_grammar, op2_patched_frame_of_reference, op3_line_field_quality, op4_forced_boundary_bpe, op5_separator_scan, op6_spot_signatures, op7_site_style_tree,
        op8_hierarchical_packing, op9_balanced_posting_lists, op10_ngram_jaccard_join,
        op11_seed_and_extend, op12_strassen_hard_negatives, op13_branch_and_bound_phrases,
    )
}
ORACLE: dict[str, str] = {
    # the given pages hold their text in one plain article, with these references only
    "op7_site_style_tree": r"""
        WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
        plain AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(b|i|a|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM cut),
        decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM plain),
        done AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded)
        SELECT page_id, url, text, length(text) AS n_chars FROM done
    """,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
        SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
        FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY reach.doc_id
    """,
    "op11_seed_and_extend": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT r, d, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM words WHERE len(w) >= 20),
        known AS (SELECT r, i, d > min(d) OVER (PARTITION BY g) OR i > min(i) OVER (PARTITION BY g, r) AS again FROM windows),
        lost AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM known WHERE again),
        single AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
        kept AS (
            SELECT r, count(*) FILTER (WHERE lost.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE lost.i IS NULL) AS kept
            FROM single LEFT JOIN lost USING (r, i) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (r)
    """,
    "op12_strassen_hard_negatives": r"""
        WITH rows AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, c.r AS cr, c.vec_id, c.label,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND a.r <> c.r),
        positives AS (
            SELECT ar, anchor_id, vec_id AS positive_id, cr, score AS positive_score FROM pairs WHERE label = al
            QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY score DESC, vec_id, n.cr) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN pairs n ON p.ar = n.ar AND n.label <> al AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op13_branch_and_bound_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        counts AS (
            SELECT lang, g, count(*) AS f FROM (
                SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS g FROM pieces)
            GROUP BY lang, g),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
        candidates AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 30),
        cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates),
        scored AS (
            SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
            FROM cuts c JOIN counts x ON c.lang = x.lang AND x.g = c.g[1:k] JOIN counts y ON c.lang = y.lang AND y.g = c.g[k + 1:len(c.g)]
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g
            FROM candidates WHERE len(g) > 2),
        covered AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN inside USING (lang, g) WHERE 100 * CAST(longer AS HUGEINT) >= 80 * CAST(a AS HUGEINT))
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
               array_to_string(g, ' ') AS phrase, a, l, r, n, score
        FROM scored s JOIN totals USING (lang) ANTI JOIN covered USING (lang, g)
        QUALIFY rank <= 2000
    """,
}
