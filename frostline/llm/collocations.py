"""Phrases whose words keep together, per language, by best-first branch and bound.

A phrase of 2 to 4 words with count a >= ``LEAST`` is a candidate. Cutting it in two parts of counts l and r scores
floor(2000000 a / (l + r)); its worst cut counts. It is dropped if a longer phrase around it has ``COVER`` of its
count. The first ``TOP`` of each language are wanted.

A phrase that begins with a part of count f and first word of count w has a <= f, so no cut of it scores more than
floor(2000000 f / (w + f)); the mirror holds for the part it ends with and its last word. These bounds are
admissible, and they fall as a part grows.

1. Words are counted, then pairs of words that are frequent themselves. The histogram of the pairs' scores gives each
   language a first threshold.
2. The frontier are pairs. Those whose bound reaches the threshold are live, best bounds first, and grow: a longer phrase is counted if
   its first pair is live as a beginning or its last one as an end, and all its pairs are frequent. A part of a phrase that scores
   the threshold is counted with it, and so is every phrase of one word more around a candidate that does. (If a longer one covers
   the candidate, so does one of these, which occurs at least as often.)
3. So scores and drops are final down to the threshold. A language with ``TOP`` survivors is settled, ties included; for the others the
   threshold falls to the score of four times as many pairs, at last to 0, where everything is counted.

Tasks count what they meet before the shuffle, so a very common word or line is a row per task. Live and frequent
pairs reach the tasks as bitmaps of hashes, of 2**28 bits at most: what they let through by chance is counted in
vain, and changes nothing. Words and phrases are told apart by 64-bit hashes of each word.

A null language is ``und``, a null or empty text has no words. Repeated rows count each time. Other columns, whatever
their names, are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run
from frostline.llm.tokens import forget
from frostline.llm.words import WordHasher

TOP = 2000
LEAST = 30
MOST_WORDS = 4
COVER = (80, 100)          # dropped if 100 * longer >= 80 * count
SCORE = 2_000_000
BREAKS = (*b".,;:!?", *range(10, 14))
BLANKS = (32, 9)
FIRST_RANK, LOWER = 2, 4   # the first threshold has room for so many times TOP pairs, each further one for LOWER times as many
BUFFER = 1 << 20           # bytes of one language's texts looked at together
HELD = 2_000_000           # phrases counted before they are sent
SHIFTS = (0, 7, 13, 19)    # places of a phrase's words in its bit
MOST_BITS = 1 << 28

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Bitmap:
    """Bits of a set of phrases, by the hashes of their words."""

    def __init__(self, flags: np.ndarray):
        self.flags, self.mask = flags, np.uint64(8 * len(flags) - 1)

    @staticmethod
    def bit(words: list[str], bits: int) -> Column:
        out = F.col(words[0])
        for name, shift in zip(words[1:], SHIFTS[1:]):
            out = out.bitwiseXOR(F.shiftrightunsigned(name, shift))
        return out.bitwiseAND(F.lit(bits - 1))

    @classmethod
    def of(cls, rows: DataFrame, words: list[str]) -> Bitmap:
        """16 bits a row and 2**28 at most; gathered as blocks of 4096 bytes."""
        bits = 1 << 16
        wanted = 16 * rows.count()
        while bits < min(wanted, MOST_BITS):
            bits *= 2
        bit = cls.bit(words, bits) + 1  # blocks are numbered by bits from 1 on
        blocks = (
            rows.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
        )
        flags = np.zeros(bits // 8, np.uint8)
        for r in blocks:
            flags[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        return cls(flags)

    def has(self, *words: np.ndarray) -> np.ndarray:
        bit = words[0]
        for w, shift in zip(words[1:], SHIFTS[1:]):
            bit = bit ^ (w >> np.uint64(shift))
        bit = bit & self.mask
        return (self.flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Pieces:
    """Words of many texts of one language: hashes, places, and whether word i and i + 1 are in one piece."""

    def __init__(self, hasher: WordHasher, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        self.start, self.end, self.words = hasher.words(data)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAK[data], out=seen[1:])
        self.joined = seen[self.start[1:]] == seen[self.end[:-1]]

    def phrases(self, m: int) -> np.ndarray:
        """Whether a phrase of m words begins at each place."""
        n = len(self.words) - m + 1
        if n <= 0:
            return np.zeros(0, bool)
        whole = np.ones(n, bool)
        for k in range(m - 1):
            whole &= self.joined[k:k + n]
        return whole

    def text(self, at: int, m: int) -> str:
        return " ".join(self.raw[self.start[k]:self.end[k]].translate(_LOWER).decode("utf-8", "surrogatepass") for k in range(at, at + m))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Pieces]]:
    """Rows (lang, text) in buffers of one language each; texts are kept apart by a break."""
    hasher, waiting, size = WordHasher(BLANKS + BREAKS, lower=True), defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            waiting[lang].append(raw)
            size[lang] += len(raw) + 1
            if size[lang] >= BUFFER:
                yield lang, Pieces(hasher, b"\n".join(waiting.pop(lang)))
                del size[lang]
        if sum(size.values()) >= 8 * BUFFER:
            for lang in list(waiting):
                yield lang, Pieces(hasher, b"\n".join(waiting.pop(lang)))
            size.clear()
    for lang, held in waiting.items():
        yield lang, Pieces(hasher, b"\n".join(held))


def by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def counted(rows: DataFrame, names: list[str], find: Callable[[Pieces], list[list[np.ndarray]]]) -> DataFrame:
    """(lang, names..., f): the phrases that ``find`` gives, as columns of word hashes, each counted over all texts (lang, text).

    Tasks send every distinct phrase they hold once, so the aggregation starts behind the shuffle."""
    def settle(held: dict[str, list[list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            columns = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            first = np.nonzero(new)[0]
            if len(first):
                counts = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(first), np.int8))), *[pa.array(c[first].view(np.int64)) for c in columns], pa.array(counts)], names=["lang", *names, "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = defaultdict(list), 0
        for lang, found in pieces(batches):
            for columns in find(found):
                held[lang].append(columns)
                size += len(columns[0])
            if size >= HELD:
                yield from settle(held)
                held, size = defaultdict(list), 0
        yield from settle(held)

    schema = ", ".join(["lang string", *(f"{c} long" for c in names), "f long"])
    return rows.mapInArrow(run, schema).repartition("lang", *names).groupBy("lang", *names).agg(F.sum("f").alias("f"))


def as_phrases(counts: DataFrame, names: list[str]) -> DataFrame:
    """(lang, words, f) with the words' hashes as an array; 0 stands for no word."""
    return counts.select("lang", F.filter(F.array(*names), lambda w: w != 0).alias("words"), "f")


def ratio(a: str, whole: Column) -> Column:
    """floor(2000000 a / whole), whatever the size of the product."""
    return F.call_function("div", F.col(a).cast("decimal(20,0)") * F.lit(SCORE).cast("decimal(7,0)"), whole.cast("decimal(20,0)"))


def scored(longer: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) by the worst cut of ``longer`` (lang, words, f), of those whose parts are all among ``phrases``."""
    m = F.size("words")
    cuts = longer.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, m - F.col("k")))
    known = (
        cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(phrases.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", ratio("a", F.col("l") + F.col("r")))
    )
    worst = known.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.count("*").alias("cuts"))
    return worst.filter(F.col("cuts") == m - 1).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, phrases: DataFrame, cover: tuple[int, int] = COVER) -> DataFrame:
    """Candidates of which no phrase of one word more has the share ``cover`` of their count."""
    around = phrases.filter(F.size("words") > 2).select(
        "lang", "f", F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words"))
    most = around.groupBy("lang", "words").agg(F.max("f").alias("longer"))
    wide = "decimal(20,0)"
    covered = F.col("longer").cast(wide) * F.lit(cover[1]) >= F.col("a").cast(wide) * F.lit(cover[0])
    return candidates.join(most, ["lang", "words"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")


def thresholds(pairs: DataFrame, rank: int) -> DataFrame:
    """(lang, least): the score that ``rank`` pairs reach, 0 if there are fewer. A histogram of whole scores is bounded by their range."""
    histogram = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = histogram.withColumn("above", F.sum("n").over(down)).withColumn("enough", F.col("above") >= rank)
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("enough"), F.col("score"))), F.lit(0)).alias("least"))


def grown(rows: DataFrame, frequent: Bitmap, begins: Bitmap, ends: Bitmap, most_words: int) -> DataFrame:
    """Counts of phrases of 3 words and more that hold frequent pairs only and begin or end with a live one."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((frequent, begins, ends))
    names = [f"w{k}" for k in range(1, most_words + 1)]

    def find(found: Pieces) -> list[list[np.ndarray]]:
        frequent, begins, ends = sent.value
        w, out = found.words, []
        if len(w) < 3:
            return out
        kept = np.zeros(len(w) - 1, bool)
        at = np.nonzero(found.joined)[0]
        kept[at] = frequent.has(w[at], w[at + 1])
        first, last = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
        at = np.nonzero(kept)[0]
        first[at], last[at] = begins.has(w[at], w[at + 1]), ends.has(w[at], w[at + 1])
        for m in range(3, most_words + 1):
            n = len(w) - m + 1
            if n <= 0:
                break
            whole = first[:n] | last[m - 2:m - 2 + n]
            for k in range(m - 1):
                whole &= kept[k:k + n]
            at = np.nonzero(whole)[0]
            out.append([w[at + k] if k < m else np.zeros(len(at), np.uint64) for k in range(most_words)])
        return out

    return counted(rows, names, find)


def spelled(rows: DataFrame, wanted: DataFrame, most_words: int) -> DataFrame:
    """``wanted`` (lang, words, ...) with the phrase as text, from a place where it occurs."""
    names = [f"w{k}" for k in range(1, most_words + 1)]
    split = wanted.select(F.size("words").alias("m"), *[F.coalesce(F.get("words", F.lit(k)), F.lit(0).cast("long")).alias(n) for k, n in enumerate(names)])
    sent = rows.sparkSession.sparkContext.broadcast([Bitmap.of(split.filter(F.col("m") == m), names[:m]) for m in range(2, most_words + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for lang, found in pieces(batches):
            langs, words, text = [], [], []
            for m, bitmap in enumerate(sent.value, 2):
                at = np.nonzero(found.phrases(m))[0]
                at = at[bitmap.has(*(found.words[at + k] for k in range(m)))]
                for place in at.tolist():
                    key = (lang, *found.words[place:place + m].tolist())
                    if key not in met:
                        met.add(key)
                        langs.append(lang)
                        words.append(found.words[place:place + m].view(np.int64))
                        text.append(found.text(place, m))
            if len(met) > 500_000:
                met = set()
            if langs:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words, pa.list_(pa.int64())), pa.array(text)], names=["lang", "words", "phrase"])

    texts = rows.mapInArrow(run, "lang string, words array<long>, phrase string")
    return wanted.join(texts.groupBy("lang", "words").agg(F.min("phrase").alias("phrase")), ["lang", "words"])


def best_phrases(docs: DataFrame, run: Run, top: int = TOP, least: int = LEAST, most_words: int = MOST_WORDS, cover: tuple[int, int] = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language by score, then count, then text."""
    rows = by_language(docs)
    counts = run.store(counted(rows, ["w1"], lambda found: [[found.words]]), "words")
    totals, words = counts.groupBy("lang").agg(F.sum("f").alias("n")), counts.filter(F.col("f") >= least)
    known = rows.sparkSession.sparkContext.broadcast(Bitmap.of(words, ["w1"]))

    def neighbours(found: Pieces) -> list[list[np.ndarray]]:
        frequent = known.value.has(found.words)
        at = np.nonzero(found.joined & frequent[:-1] & frequent[1:])[0]
        return [[found.words[at], found.words[at + 1]]]

    pairs = run.store(counted(rows, ["w1", "w2"], neighbours).filter(F.col("f") >= least), "pairs")
    short = as_phrases(words, ["w1"]).union(as_phrases(pairs, ["w1", "w2"]))
    pair_scores = run.store(scored(short.filter(F.size("words") == 2), short), "pair-scores")
    frequent, names = Bitmap.of(pairs, ["w1", "w2"]), [f"w{k}" for k in range(1, most_words + 1)]

    rank, remaining, finished, round_ = FIRST_RANK * top, totals.select("lang"), [], 0
    while not remaining.isEmpty():
        limit = run.store(thresholds(pair_scores, rank).join(remaining, "lang"), f"limit{round_}")
        bounded = pair_scores.join(limit, "lang").select(
            F.get("words", F.lit(0)).alias("w1"), F.get("words", F.lit(1)).alias("w2"), "least", ratio("a", F.col("l") + F.col("a")).alias("begins"), ratio("a", F.col("r") + F.col("a")).alias("ends"))
        begins, ends = (Bitmap.of(bounded.filter(F.col(side) >= F.col("least")), ["w1", "w2"]) for side in ("begins", "ends"))
        here = rows.join(remaining, "lang", "left_semi") if round_ else rows
        longer = run.store(grown(here, frequent, begins, ends, most_words).filter(F.col("f") >= least), f"longer{round_}")
        phrases = short.join(limit, "lang", "left_semi").union(as_phrases(longer, names))
        reached = scored(as_phrases(longer, names), phrases).union(pair_scores).join(limit, "lang").filter(F.col("score") >= F.col("least"))
        kept = run.store(uncovered(reached, phrases, cover), f"kept{round_}")
        state = limit.join(kept.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left").withColumn("settled", (F.col("least") == 0) | (F.coalesce("found", F.lit(0)) >= top))
        state = run.store(state.select("lang", "settled"), f"state{round_}")
        finished.append(kept.join(state.filter("settled"), "lang", "left_semi"))
        rank, remaining, round_ = LOWER * rank, state.filter("NOT settled").select("lang"), round_ + 1

    # languages without a frequent pair have no candidates and never get a threshold
    best = finished[0] if finished else pair_scores.withColumn("least", F.lit(0).cast("long"))
    for part in finished[1:]:
        best = best.union(part)
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    chosen = run.store(best.withColumn("place", F.rank().over(best_first)).filter(F.col("place") <= top).drop("place", "least"), "chosen")  # with all ties at the end
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    named = spelled(rows, chosen, most_words).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
