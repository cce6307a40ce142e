"""Jaccard join, components, spot signatures and posting lists against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import catalog, jaccard, posting_lists, spotsigs
from frostline.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def least_reachable(rows):
    """component of each row index, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                label[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(seed, words=60, groups=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, words))]
        if g % 2:
            base = base[:10] + passage + base[10:]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text[:rng.randint(3, len(text))]
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else "\n".join(text))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "fits", "block"), [(1, 2048, 64), (2, 4, 3), (3, 9, 5)])
def test_join_equals_all_pairs(make_docs, run_of, seed, fits, block):
    """All cells joined by one task each, and nearly all divided by pivots and compared in blocks."""
    rows = near_copies(seed)
    got = jaccard.near_duplicates(make_docs(rows, extra=True).repartition(5), run_of("join"), fits=fits, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == least_reachable(rows)


def crowd(members, seed, universe=40):
    """Sets around a few bases, near the threshold of linking, and chains of sets that link only with the next."""
    rng = np.random.default_rng(seed)
    hashes = rng.integers(1, 1 << 62, universe * 12).astype(np.uint64)
    bases = [rng.choice(hashes, universe, replace=False) for _ in range(6)]
    sets = []
    for k in range(members):
        base = bases[k % 6].copy()
        at = rng.choice(universe, int(rng.integers(0, 12)), replace=False)
        base[at] = rng.choice(hashes, len(at))
        sets.append(np.unique(base[:int(rng.integers(universe // 2, universe + 1))]))
    return sets


def labels_of(count, links):
    label = list(range(count))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        label[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(count)]


def all_links(sets):
    holds = np.zeros((len(sets), len(np.unique(np.concatenate(sets)))), np.float32)
    order = {h: k for k, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    for k, x in enumerate(sets):
        holds[k, [order[h] for h in x.tolist()]] = 1
    common = (holds @ holds.T).astype(int)
    size = np.array([len(x) for x in sets])
    a, b = np.nonzero(100 * common >= 75 * (size[:, None] + size - common))
    return [(int(x), int(y)) for x, y in zip(a, b) if x < y]


@pytest.mark.parametrize("seed", range(6))
def test_links_inside_a_cell_join_all_that_link(seed):
    sets = crowd(400, seed)
    assert labels_of(400, jaccard.cell_links(sets)) == labels_of(400, all_links(sets))
    assert len(jaccard.cell_links(sets)) < 400  # a link joins two components, or is not listed


def test_a_cell_of_thousands_is_divided_exactly(spark, run_of):
    """5,000 members in one cell of which 1,000 fit a task: pivots, regions and blocks join all that link, and no more."""
    sets = crowd(5_000, 11)
    names = [int.from_bytes(hashlib.blake2b(b"%d" % k, digest_size=7).digest(), "little") for k in range(5_000)]
    run = run_of("crowd")
    stored = run.store(spark.createDataFrame([(n, x.tobytes()) for n, x in zip(names, sets)], "class long, set binary"), "sets")
    members = spark.createDataFrame([(7, n, len(x)) for n, x in zip(names, sets)], "cell long, class long, n int")
    large = run.store(jaccard.with_count(members), "large")
    none = spark.createDataFrame([], "a long, b long")
    links = jaccard.divided(large, stored, none, run, jaccard.SIMILAR, fits=1_000, block=512).collect()
    number = {n: k for k, n in enumerate(names)}
    assert labels_of(5_000, [(number[r["a"]], number[r["b"]]) for r in links]) == labels_of(5_000, all_links(sets))


def test_join_of_awkward_rows(make_docs, run_of):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "a b c d e"), (8, "A\tB c d e"), (9, "x" * 100_000),
            (9, "x" * 100_000), (10, "é È 日本 ü z"), (None, "a b c d e"), (None, "only here as it is"), (11, "only here as it is")]
    got = jaccard.near_duplicates(make_docs(rows), run_of("join"))
    assert sorted(map(tuple, got.collect()), key=str) == least_reachable(rows)
    assert jaccard.near_duplicates(make_docs([]), run_of("join")).count() == 0
    assert jaccard.near_duplicates(make_docs([(1, None)]), run_of("join")).collect()[0]["component_id"] == 1


def test_members_travel_as_texts_below_the_room_of_their_sets(spark, make_docs):
    """What is shuffled twice for a member of a cell is less than half of its 64-bit shingles, and gives the same ones back."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(500))) for k in range(20)] + [(20, "a B"), (21, "é \U0001f600 x\ty z w"), (None, "b b b b b b b")]
    name = jaccard.class_of
    sets = {i: jaccard.Shingler().shingles(t) for i, t in rows}
    members = spark.createDataFrame([(c, name(s), i) for i, s in sets.items() for c in (1, 2)], "cell long, class long, rep long")
    got = jaccard.with_texts(make_docs(rows), members, 5).collect()
    assert sorted((r["cell"], r["class"]) for r in got) == sorted((c, name(s)) for s in sets.values() for c in (1, 2))
    read, by_class = jaccard.unpacked(5), {name(s): s for s in sets.values()}
    assert all((read(r["packed"]) == by_class[r["class"]]).all() for r in got)
    assert sum(len(r["packed"]) for r in got) < 8 * sum(2 * len(s) for s in sets.values()) / 2
    stored = jaccard.stored_sets(make_docs(rows), members.select("class", "rep").distinct(), 5).collect()
    assert {r["class"]: r["set"] for r in stored} == {c: s.tobytes() for c, s in by_class.items()} and len(stored) == len(rows)


def test_a_region_row_is_a_short_name_and_a_class(make_docs):
    """Nothing else goes through the largest shuffle; names take five bytes, and a set has as many as its prefix asks for."""
    rows = [(1, " ".join(f"w{k}" for k in range(64))), (2, "a b c"), (3, None)]
    got = jaccard.prefixes(make_docs(rows), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 5, jaccard.SIMILAR)
    assert got.columns == ["shingle", "class"]
    found = got.collect()
    assert all(0 <= r["shingle"] < 1 << 40 for r in found) and len(found) == jaccard.prefix_size(60) + jaccard.prefix_size(1)


def test_exact_bound_counts_as_link(make_docs, run_of):
    # 10 shingles and 8 of them with no other: 8 * 100 >= 75 * 10; with 7 of 10 there is no link
    words = [f"v{k}" for k in range(14)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:11]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(make_docs(rows), run_of("join")).collect()}
    assert least_reachable(rows) == sorted(((i, n, got[i]) for i, n, _ in least_reachable(rows)), key=str)


def test_shingles_do_not_depend_on_buffer_size():
    s = jaccard.Shingler()
    text = " ".join(f"word{k % 977}" for k in range(40_000))
    assert len(s.shingles(text)) == len(shingle_set(text))
    assert (s.shingles("a b c d e f") == jaccard.Shingler().shingles("A  b\nc d\te f ")).all()


def test_components_of_a_chain_a_star_and_nothing(spark, run_of):
    links = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), run_of("cc")).collect()))
    assert {got[k] for k in range(100, 181)} == {100} and {got[k] for k in range(500, 560)} == {500} and got[9] == 8 and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long"), run_of("cc")).count() == 0


def test_join_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.QUERIES["op10_ngram_jaccard_join"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == least_reachable(rows)


# Spot signatures

def plain_spots(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    anchors, others = set(spotsigs.ANCHORS), set(spotsigs.STOPWORDS) - set(spotsigs.ANCHORS)
    units, held = [], []
    for w in (w for w in words if w not in others):
        if w in anchors:
            held.append(w)
        else:
            units.append((tuple(held), w))
            held = []
    if held:
        units.append((tuple(held), ""))
    return {(a, w, units[i + 1][1] if i + 1 < len(units) else None) for i, (a, w) in enumerate(units) if a}


def test_spots_are_chains_behind_anchors(spark):
    texts = ["The quick brown fox and the lazy dog", "the THE of  house, garden", "nothing here", "", "12 % 34"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r["s"] for r in spotsigs.with_spots(df, "text", "s").collect()]
    for t, s in zip(texts, found):
        assert len(s) >= len(plain_spots(t))
        assert (len(s) > 0) == bool(re.search(r"\w", t))
    same = spark.createDataFrame([("The quick, brown fox!",), ("the QUICK brown fox",)], "text string")
    a, b = (r["s"] for r in spotsigs.with_spots(same, "text", "s").collect())
    assert a == b


def test_edited_texts_follow_descending_ids(make_docs):
    rows = [(5, "The house of a friend is old and the garden is wide"), (50, None), (7, ""), (9, "é" * 7), (8, "of the sea and of the sun " * 40),
            (1, "short"), (-3, "The house of a friend is old and the garden is wide")]
    order = sorted(rows, reverse=True)
    for buckets in (1, 3, 8):
        got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(make_docs(rows, extra=True), buckets).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            text, other = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(text) // 2
            edited = text[:len(text) - half] + other[:half]
            assert got[i]["n_chars"] == len(text)
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i]["near_next"] == (1.0 if got[i]["fingerprint"] == got[order[(k + 1) % len(order)][0]]["fingerprint"] else got[i]["near_next"])
            assert 0 <= got[i]["near_edited"] <= 1
        assert got[5]["fingerprint"] == got[-3]["fingerprint"] and got[50]["near_edited"] == 1.0


def test_edited_texts_of_one_no_and_repeated_rows(make_docs):
    one = spotsigs.edited_fingerprints(make_docs([(4, "abcd")]), 4).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert spotsigs.edited_fingerprints(make_docs([]), 4).count() == 0
    same = spotsigs.edited_fingerprints(make_docs([(4, "the sun is up"), (4, "the sun is up"), (None, "x y"), (2, "of it")]), 4)
    assert same.count() == 4


def test_length_partitions_hold_every_similar_pair(spark):
    sizes = spark.range(1, 200).selectExpr("id AS a").crossJoin(spark.range(1, 200).selectExpr("id AS b"))
    part = lambda c: spotsigs.length_partition(F.col(c), 0.75)
    lost = sizes.filter(F.least("a", "b") >= 0.75 * F.greatest("a", "b")).filter(F.abs(part("a") - part("b")) > 1)
    assert lost.count() == 0


# Posting lists

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")


def brute(rows, queries, k=10):
    kept = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in kept:
        if queries(i):
            far = sorted((float(np.sqrt(((np.asarray(v, np.float32).astype(float) - np.asarray(q, np.float32).astype(float)) ** 2).sum())), j) for j, v in kept if j != i)
            out[i] = [j for _, j in far[:k]]
    return out


def test_posting_lists_recall_and_scores(spark, run_of):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16))
    rows = [(i, (centre[rng.integers(30)] + 0.7 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, [0.5] * 16) for i in range(700)]  # one very common vector
    want = brute(rows, lambda i: i % 100 == 0)
    got = posting_lists.nearest(vectors(spark, [(i, v, 1) for i, v in rows]), lambda c: c % 100 == 0, run_of("ann")).collect()
    found, data = {}, {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
        assert r["score"] == pytest.approx(np.sqrt(((data[r["query_id"]] - data[r["vec_id"]]) ** 2).sum()), abs=1e-12)
    assert found.keys() == want.keys()
    assert np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert found[2000] == want[2000] and found[2100] == want[2100]  # ties go to smaller ids


def test_posting_lists_recall_without_clusters(spark, run_of):
    """Neighbours are spread over many lists; a fixed ratio of centroid distances finds two thirds of them."""
    x = np.random.default_rng(4).normal(size=(6000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = posting_lists.nearest(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]), lambda c: c % 100 == 0, run_of("ann")).collect()
    asked = np.arange(0, len(x), 100)
    far = posting_lists.distances(x[asked], x)
    far[np.arange(len(asked)), asked] = np.inf
    want = {(100 * i, j) for i, row in enumerate(np.argsort(far, axis=1)[:, :10].tolist()) for j in row}
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_border_vectors_join_several_lists(spark):
    x = np.random.default_rng(6).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = posting_lists.CentroidGraph.build(posting_lists.balanced_centroids(x, 60))
    rows = posting_lists.usable(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]))
    assert posting_lists.post(rows, spark.sparkContext.broadcast(graph)).count() > 1.02 * len(x)


def test_a_query_on_a_small_list_reads_further():
    """Three copies are a list of their own; a query among them still reads ten others, and no list beyond these."""
    x = np.concatenate([np.tile([1.0, 0.0], (3, 1)), [[5.0, 0.1 * i] for i in range(20)], [[90.0, 0.1 * i] for i in range(20)]])
    at = np.repeat([0, 1, 2], [3, 20, 20])
    centre = np.array([x[at == i].mean(0) for i in range(3)])
    index = posting_lists.Index(posting_lists.CentroidGraph.build(centre), np.arange(len(x)), x, at, np.arange(len(x)), 1e-3)
    read, bound = index.choose(np.array([0]), x[:1], 10)
    assert read.tolist() == [[True, True, False]]
    assert bound[0] == np.sort(np.sqrt(((x[1:23] - x[0]) ** 2).sum(1)))[9]


def test_vectors_that_take_no_part(spark, run_of):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (100, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (200, [1.0, 0.0]), (200, [1.0, 0.0]), (None, [1.0, 1.0])]
    got = posting_lists.nearest(vectors(spark, [(i, v, 1) for i, v in rows]), lambda c: c % 100 == 0, run_of("ann")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 200), (0, 2, 1), (200, 1, 0), (200, 2, 1)]
    assert posting_lists.nearest(vectors(spark, []), lambda c: c % 100 == 0, run_of("ann")).count() == 0


def test_graph_reaches_what_a_scan_finds():
    rng = np.random.default_rng(1)
    graph = posting_lists.CentroidGraph.build(rng.normal(size=(300, 8)))
    x = rng.normal(size=(200, 8))
    near, far = graph.search(x, 32)
    exact = posting_lists.distances(x, graph.centre).argsort(axis=1)[:, 0]
    assert (near[:, 0] == exact).mean() >= 0.97 and (np.diff(far, axis=1) >= 0).all()
