"""Substring dedup, hard negatives and phrase mining against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm import collocations, hard_negatives, substring_dedup
from frostline.llm.words import CHUNK, WordHasher, grams, sliding_least, sums

# ---------------------------------------------------------------- words


@given(st.text(alphabet="ab \t\n\rÉ", max_size=60))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_the_pattern(text):
    raw = text.encode()
    start, end, found = WordHasher().words(np.frombuffer(raw, np.uint8))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert [raw[a:b].decode() for a, b in zip(start, end)] == words
    assert len(set(found.tolist())) == len(set(words))


def test_words_across_chunks_and_a_word_longer_than_one():
    text = "x" * (CHUNK + 10) + " " + "word other " * (CHUNK // 8) + "y" * (2 * CHUNK)
    _, _, found = WordHasher().words(np.frombuffer(text.encode(), np.uint8))
    assert len(found) == len(text.split()) and len(set(found.tolist())) == 4


def test_grams_and_least_of_windows():
    words = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    got = grams(sums(words), 3)
    assert len(got) == 198 and len(set(got.tolist())) == len({tuple(words[i:i + 3]) for i in range(198)})
    for n in (1, 2, 5, 13):
        assert sliding_least(got, n).tolist() == [got[i:i + n].min() for i in range(len(got) - n + 1)]
    assert len(grams(sums(words[:2]), 3)) == 0


# ---------------------------------------------------------------- substring dedup


def without_earlier(rows, window):
    """(doc_id, n_words, n_removed, kept) by a list of all windows; unnamed rows are left out of ``rows``."""
    least, own = {}, []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own.append(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, own):
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if least[key] < i or key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def shared_passages(seed, docs=60, vocabulary=12):
    rng = random.Random(seed)
    letters = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(letters) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        rows.append((rng.randint(0, 3 * docs), rng.choice([" ", "\n", "  \t"]).join(text)))
    return rows


def repeats_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, seed_words, held", [(20, 8, 1_000_000), (20, 8, 30), (6, 6, 5), (7, 2, 50)])
def test_repeats_equal_brute_force(make_docs, run_of, monkeypatch, window, seed_words, held):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    rows = shared_passages(window + held) + [
        (500, "same " * 90), (501, "same " * 30), (502, "a b c " * 40), (503, "b c a " * 40), (504, None), (505, ""), (506, " \n\t"),
        (507, "one two three"), (7, "É" + " ü" * 50), (8, "É" + " ü" * 50), (8, "É" + " ü" * 50), (8, "another text " * 3)]
    docs = make_docs(rows, extra=True).repartition(5)
    got = substring_dedup.repeats(docs, run_of("repeats"), window, seed_words)
    assert repeats_of(got) == without_earlier(rows, window)


def test_spans_are_maximal_and_rows_without_id_come_last(make_docs, run_of):
    passage = " ".join(f"p{k}" for k in range(25))
    docs = make_docs([(3, f"x {passage} y"), (5, f"{passage} z {passage}"), (None, f"q r {passage}"), (None, None)])
    got = {(r.doc_id, r.n_words): r for r in substring_dedup.repeats(docs, run_of("spans")).collect()}
    assert got[3, 27].spans == [] and got[3, 27].kept == f"x {passage} y"
    assert [tuple(s) for s in got[5, 51].spans] == [(0, 25), (26, 51)] and got[5, 51].kept == "z"
    assert [tuple(s) for s in got[None, 27].spans] == [(2, 27)] and got[None, 27].kept == "q r"
    assert got[None, 0].kept == "" and got[None, 0].n_removed == 0


def test_repeats_of_an_empty_table_and_a_very_long_text(make_docs, run_of):
    assert substring_dedup.repeats(make_docs([]), run_of("empty")).collect() == []
    long = " ".join(f"n{k}" for k in range(200_000))
    got = substring_dedup.repeats(make_docs([(1, long), (2, "head " + long)]), run_of("long")).collect()
    assert {(r.doc_id, r.n_removed, r.kept if r.doc_id == 2 else "") for r in got} == {(1, 0, ""), (2, 200_000, "head")}


def test_a_group_of_copies_costs_one_row_a_task(make_docs):
    """However many copies a task meets, an anchor is sent once, and nothing is opened for whole copies."""
    text = " ".join(f"c{k}" for k in range(60))
    met = substring_dedup.stretches(make_docs([(i, text) for i in range(300)]).coalesce(1))
    kinds = Counter(r["kind"] for r in met.collect())
    assert kinds["open"] == 0 and kinds["gone"] == 299 * kinds["join"]


# ---------------------------------------------------------------- hard negatives


@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 6), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_strassen_equals_the_plain_product(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-10 ** 6, 10 ** 6, (m, k)), rng.integers(-10 ** 6, 10 ** 6, (k, n))
    assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def test_scores_beyond_64_bits_count_as_the_nearest():
    a = np.array([[1 << 40, 3], [1 << 62, 0], [-(1 << 62), 1]])
    b = np.array([[1 << 20, 1], [2, 5]])
    want = [[max(-hard_negatives.MOST, min(hard_negatives.MOST, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
    assert hard_negatives.scores(a, b).tolist() == want


def test_whole_numbers_are_floors_at_any_size():
    values = np.array([0.1, -0.1, 1e300, -1e308, 2.0 ** 60, 0.0])
    assert hard_negatives.whole_numbers(values).tolist() == [25, -26, hard_negatives.MOST, -hard_negatives.MOST, hard_negatives.MOST, 0]
    for row in ([1, -2], [300, -300], [1 << 20], [1 << 40], []):
        whole = np.array([row], np.int64)
        assert hard_negatives.unpack(hard_negatives.pack(whole), 1).tolist() == [row]


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("slot", T.StringType())])


def mined(rows, every=10):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, k, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, k, label, v in kept:
        if i % every:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for j, m, other, w in kept if m != k)
        for s, j, m, other in [x for x in score if x[3] == label][:5]:
            negatives = [(t, n) for t, n, _, o in score if o != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(negatives, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [4, 2048])
def test_hard_negatives_equal_brute_force(spark, run_of, tile):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=7).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(30)] + [rows[10]] * 3  # copies, ties, repeated anchors
    rows += [(None, [1.0] * 7, 1), (30, None, 1), (40, [1.0] * 7, None), (50, [1.0, None], 1), (60, [float("nan")] * 7, 1), (70, [float("inf")] * 7, 1), (80, [], 1), (90, [2.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("label"), lambda i: i % 10 == 0, run_of("negatives"), tile=tile)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_hard_negatives_of_an_empty_table_and_of_no_anchor(spark, run_of):
    for rows in ([], [(1, [1.0], 1, "x")], [(10, [1.0], 1, "x")]):
        df = spark.createDataFrame(rows, VECTORS)
        got = hard_negatives.hard_negatives(df, F.col("label"), lambda i: i % 10 == 0, run_of("none"))
        assert got.collect() == [] and got.columns[0] == "anchor_id"


# ---------------------------------------------------------------- phrases


def phrases_of(rows, top, least):
    """Every phrase counted and scored."""
    count = {}
    for text, lang in rows:
        seen = count.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                seen.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, seen in count.items():
        n = sum(c for g, c in seen.items() if len(g) == 1)
        held = {g: c for g, c in seen.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in held.items():
            if any(len(q) > len(g) and 100 * c >= 80 * a and any(q[i:i + len(g)] == g for i in range(len(q))) for q, c in held.items()):
                continue
            score, k = min((2_000_000 * a // (seen[g[:k]] + seen[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), seen[g[:k]], seen[g[k:]]))
        out += [(lang, rank, g.decode(), -a, left, right, n, -s) for rank, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def babble(seed, rows=150):
    rng = random.Random(seed)
    fixed = ["new york city hall", "au fait", "one Two three", "ß ẞ É é"]
    out = []
    for _ in range(rows):
        text = ""
        for _ in range(rng.randint(0, 12)):
            text += rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 30}"
            text += rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."])
        out.append((text, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", "de"), (None, None), ("...", "xx")]


@pytest.mark.parametrize("top, least, held", [(5, 2, 2_000_000), (40, 3, 20), (2000, 2, 2_000_000), (1, 4, 2_000_000)])
def test_phrases_equal_brute_force(spark, run_of, monkeypatch, top, least, held):
    monkeypatch.setattr(collocations, "HELD", held)
    rows = babble(top + least)
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("1 AS doc_id", "text", "lang", "'x' AS f", "'y' AS words").repartition(4)
    got = collocations.best_phrases(docs, run_of("phrases"), top=top, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, top, least)


def test_thresholds_fall_until_enough_phrases_survive(spark, run_of, monkeypatch):
    """Pairs that a longer phrase covers fill the first ranks, so the frontier must grow more than once."""
    rounds = []
    grown = collocations.grown
    monkeypatch.setattr(collocations, "grown", lambda *a: rounds.append(1) or grown(*a))
    rows = [(f"a{k} b{k} c{k} d{k}.", "en") for k in range(30) for _ in range(5)] + [(f"x{k % 7} y{k % 5}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.best_phrases(docs, run_of("rounds"), top=35, least=3)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, 35, 3)
    assert len(rounds) > 1


def test_phrases_of_an_empty_table(spark, run_of):
    assert collocations.best_phrases(spark.createDataFrame([], "text string, lang string"), run_of("none")).collect() == []


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000,)], "a long").select(collocations.ratio("a", F.col("a") + F.lit(0)).alias("s"))
    assert df.first()["s"] == 2_000_000
