"""Exact Jaccard self-join of word n-gram sets in metric space, and its components.

Jaccard distance is a metric, so documents can be joined by regions around pivots.

1. Equal sets are one class from the start; only classes are compared.
2. Single shingles are the first pivots: {s} is nearer to a set that holds s than to any other.
   A set of n shingles takes part in the regions of its n - ceil(t n) + m first shingles in one
   order of all shingles (rare ones first); a linked set can lack no more than n - ceil(t n) of them,
   so both meet in m regions. That count is the window by which border sets are replicated. m is a sixth of n,
   so a set that shares fewer shingles than that with any others, such as one common passage, has no link
   and leaves all its regions. Two sets that meet in m regions also meet in one of all but the last m - 1 that each has, in one
   order of the regions: the smallest come first, and a set stays in that many. A passage of many documents is left first.
3. Each region names its most central member as document pivot. Regions of one pivot form its
   Voronoi cell; members that no other member's size allows to link with leave it.
4. A cell that fits a task is joined there, exactly: members are compared with all others through their postings, but only those
   of different components whose distances to the members compared so far differ by no more than 1 - t (triangle inequality).
5. A larger cell is divided: several of its members become pivots, every member is measured against them and goes to its nearest
   one's region, and also to any other that is farther by no more than 2 (1 - t), the window in which its partners can live.
   Members that are linked to all they could link with leave first; small regions are joined, large ones divided again. A cell
   whose regions would hold nearly all its pairs, as a crowd of near copies, is compared in blocks: only members of
   different components, with the same bounds.

No pair that could link escapes these steps, so the components are exact; links inside a component
that is known already are not listed. Shingles are compared by 64-bit hashes; where members travel to
their cell, their deflated texts do, which take less than half of the hashes' room, and are cut into shingles there.
The order of shingles affects cost only: it comes from counts that every task takes over all of its
shingles, of which the 2**18 highest are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.components import components
from frostline.llm.shared import Run, texts
from frostline.llm.tokens import forget

WORDS = 5
SIMILAR = (75, 100)        # linked when 100 * common >= 75 * united
FREQUENT = 1 << 18         # shingles whose frequency orders the regions
SEEN_OFTEN = 3             # times within COUNT_OVER shingles of a task
COUNT_OVER = 2_000_000
MEETINGS = 6               # linked sets meet in one region for so many shingles
FITS = 2048                # members of a cell that one task joins
HOLDS = 8_000_000          # and shingles of its members in all: 64 MB
PIVOTS = 8                 # pivots that divide a larger cell, and members against which distances are kept
SHRINKS = 0.5              # a cell is divided if its regions together have less than this share of its pairs
NAME_BITS = 40             # of a shingle's hash name its region; shingles of one name share a region, which adds company but loses none
BLOCK = 256                # members of one side in a block comparison
MOST_BITS = 1 << 28        # hashed ids of the documents whose sets are fetched, 16 bits each and 32 MB at most

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * _M)
        self.base = np.uint64(0xD1342543DE82EF95)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.place = mix(np.arange(1, words + 1, dtype=np.uint64) * _M) | np.uint64(1)
        kinds = np.zeros(256, bool)
        kinds[[32, *range(9, 14)]] = True
        self.space = kinds
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ones = np.ones(n, np.uint64)
        self.power = np.cumprod(ones * self.base)
        self.undo = np.cumprod(ones * self.inverse)

    def word_hashes(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self._grow(2 * len(raw) + 1)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = self.space[raw]
        edge = np.nonzero(gap[1:] != gap[:-1])[0]
        start, end = edge[0::2], edge[1::2]
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letter[self.lower[raw]] * self.power[:len(raw)], out=run[1:])
        return mix((run[end] - run[start]) * self.undo[start])

    def shingles(self, text: str) -> np.ndarray:
        w = self.word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
        if not len(w):
            return w
        if len(w) < self.words:  # the whole sequence, told apart from shingles by its length
            return mix((w * self.place[:len(w)]).sum(keepdims=True) + np.uint64(len(w)) * _M)
        n = len(w) - self.words + 1
        total = np.zeros(n, np.uint64)
        for i in range(self.words):
            total += w[i:i + n] * self.place[i]
        return np.unique(mix(total))


def class_of(shingles: np.ndarray) -> int:
    """64-bit name of a set: sets of one name and size are taken as equal."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Regions of a set of n shingles: sets that link have at least a sixth of the smaller one's size in common."""
    return n - -(-similar[0] * n // similar[1]) + max(1, n // MEETINGS)


def meetings(n: str, similar: tuple[int, int] = SIMILAR) -> Column:
    """Regions that a set of n shingles shares with any set it links with: that one has at least
    ceil(t n) shingles, and the two meet in as many regions as the smaller one's share asks for."""
    return F.greatest(F.expr(f"({similar[0]} * {n} + {similar[1] - 1}) div {similar[1]} div {MEETINGS}"), F.lit(1))


def sets_and_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of documents (doc_id, n, class) and of shingles that a task meets often (shingle, seen)."""
    names, kinds = ["doc_id", "n", "class", "shingle", "seen"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, seen = np.unique(np.concatenate(parts), return_counts=True)
        found, seen = found[seen >= SEEN_OFTEN], seen[seen >= SEEN_OFTEN]
        columns = [pa.nulls(len(found), k) for k in kinds[:3]] + [pa.array(found.view(np.int64)), pa.array(seen)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler, parts, held = Shingler(words), [], 0
        for batch in batches:
            sizes, classes = [], []
            for text in batch.column(1).to_pylist():
                s = shingler.shingles(text)
                sizes.append(len(s))
                classes.append(class_of(s))
                parts.append(s)
                held += len(s)
                if held >= COUNT_OVER:
                    yield often(parts)
                    parts, held = [], 0
            columns = [batch.column(0), pa.array(sizes, kinds[1]), pa.array(classes, kinds[2])]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(sizes), k) for k in kinds[3:]], names=names)
        if parts:
            yield often(parts)

    return texts(docs).mapInArrow(run, "doc_id long, n int, class long, shingle long, seen long")


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, similar: tuple[int, int]) -> DataFrame:
    """(shingle, class): the regions in which each set takes part.

    A region is named by the first ``NAME_BITS`` bits of its shingle. A set takes regions until their names are as many as its
    prefix asks for, so two sets that meet in m shingles also meet in m names."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent)
    names = ["shingle", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (known, seen), met = Shingler(words), order.value, set()
        for batch in batches:
            found, rows = [], []
            for text in batch.column(1).to_pylist():
                s = shingler.shingles(text)
                name = class_of(s)
                if not len(s) or name in met:
                    continue
                met.add(name)
                often = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, seen[at], 0)
                regions, size = s[np.argsort(often, kind="stable")] >> np.uint64(64 - NAME_BITS), prefix_size(len(s), similar)
                first = regions[:size]
                if len(np.unique(first)) < size:
                    first = regions[np.sort(np.unique(regions, return_index=True)[1])[:size]]
                found.append(first)
                rows.append((name, len(first)))
            if len(met) > 500_000:
                met = set()
            if rows:
                name, times = (np.array(c, np.int64) for c in zip(*rows))
                columns = [np.concatenate(found).view(np.int64), np.repeat(name, times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return texts(docs).mapInArrow(run, "shingle long, class long")


def shared_regions(regions: DataFrame) -> DataFrame:
    """(shingle, class, here) of regions with two members or more; others hold no pair. ``here`` orders the regions."""
    region = Window.partitionBy("shingle")
    mixed = regions.select("*", F.min("class").over(region).alias("least"), F.max("class").over(region).alias("most"), F.count("*").over(region).alias("here"))
    return mixed.filter("least <> most").drop("least", "most").dropDuplicates(["shingle", "class"])


def cells(shared: DataFrame, sizes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(cell, class): members of each pivot's cell, the pivot among them. ``sizes`` has (class, n). A cell's name is its pivot's
    centrality, the share of its shingles whose regions it shares, and part of its class.

    Sets that meet others too seldom to link with any have left before the pivots are named, and every set all but its first regions."""
    own, region = Window.partitionBy("class"), Window.partitionBy("shingle")
    met = shared.withColumn("met", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("here", "shingle")))
    met = met.join(sizes.select("class", "n"), "class")
    kept = met.filter((F.col("met") >= meetings("n", similar)) & (F.col("place") <= F.col("met") - meetings("n", similar) + 1))
    central = F.least(F.expr("32767 * met div n"), F.lit(32767))
    name = F.expr("shiftleft(central, 47) | shiftrightunsigned(class, 17)")
    named = kept.select("shingle", "class", central.alias("central")).select(
        "class", F.max(name).over(region).alias("cell"), F.count("*").over(region).alias("here"))
    return named.filter("here > 1").select("cell", "class").distinct()


def sizes_agree(a: str, b: str, similar: tuple[int, int]) -> Column:
    return F.lit(similar[1]) * F.least(a, b).cast("long") >= F.lit(similar[0]) * F.greatest(a, b).cast("long")


def size_band(n: str, similar: tuple[int, int]) -> Column:
    """Bands of sizes one similarity wide: sizes that agree are in the same or in neighbouring bands."""
    return F.floor(F.log(n) / F.lit(float(np.log(similar[1] / similar[0])))).cast("int")


def bands_around(band: str) -> Column:
    return F.explode(F.array(F.col(band) - 1, F.col(band), F.col(band) + 1)).alias(band)


def in_company(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Members (cell, class, n, ...) of cells that meet another one of a size they could link with."""
    everyone = members.withColumn("band", size_band("n", similar))
    company = everyone.groupBy("cell", "band").agg(F.count("*").alias("here")).select("cell", bands_around("band"), "here")
    company = company.groupBy("cell", "band").agg(F.sum("here").alias("here")).filter("here > 1")
    return everyone.join(company.select("cell", "band"), ["cell", "band"]).select(members.columns)


def fetched(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, doc_id, packed) of the documents ``rep`` of ``wanted`` (class, rep), and of a few others.

    They are found in a bitmap of hashed ids; what it lets through by chance is left out by the join that follows."""
    bits, count = 1 << 20, wanted.count()
    while bits < min(64 * count, MOST_BITS):
        bits *= 2
    bit = F.pmod(F.xxhash64("rep"), F.lit(bits))
    maps = (
        wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()  # bits / 8 bytes in all
    )
    # bucket b holds the bits from (b - 1) * 32768 + 1 on; bit 0 is bucket 0's
    flags = np.zeros(bits // 8 + 2 * 4096, np.uint8)
    for r in maps:
        flags[r["b"] * 4096:(r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, flags = Shingler(words), held.value
        for batch in batches:
            where = batch.column(0).to_numpy() * 32768 + batch.column(1).to_numpy()
            rows = np.nonzero(flags[where >> 3] >> (where & 7).astype(np.uint8) & 1)[0]
            for a in range(0, len(rows), 200):
                at = pa.array(rows[a:a + 200])
                found = batch.column(3).take(at).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([class_of(shingler.shingles(t)) for t in found], pa.int64()), batch.column(2).take(at),
                    pa.array([packed(t) for t in found], pa.binary())], names=["class", "doc_id", "packed"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = texts(docs).select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p"), "doc_id", "text")
    return rows.mapInArrow(run, "class long, doc_id long, packed binary")


def packed(text: str) -> bytes:
    """A text as it travels: deflated, well below the eight bytes that each of its shingles' hashes takes."""
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 1)


def unpacked(words: int) -> Callable[[bytes], np.ndarray]:
    """A reader of the shingles of packed texts."""
    shingler = Shingler(words)
    return lambda raw: shingler.shingles(zlib.decompress(raw).decode("utf-8", "surrogatepass"))


def with_texts(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(cell, class, packed) of ``members`` (cell, class, rep), each with the text of one document; rows that repeat its doc_id repeat it."""
    found = fetched(docs, members.select("class", "rep").distinct(), words)
    return found.join(members.select("cell", "class", "rep"), "class").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).select("cell", "class", "packed")


def stored_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, set) of the classes in ``wanted`` (class, rep)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = unpacked(words)
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                sets = [read(x.as_py()).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["class", "set"])

    found = fetched(docs, wanted, words).select("class", "packed").join(wanted.select("class"), "class").dropDuplicates(["class"])
    return found.select("class", "packed").mapInArrow(run, "class long, set binary")


class Postings:
    """Members of a cell by the shingles they hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order[1:]] != flat[order[:-1]]
        self.start = np.append(np.nonzero(new)[0], len(flat))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.shingle = np.empty(len(flat), np.int64)
        self.shingle[order] = np.cumsum(new) - 1

    def common(self, x: int) -> np.ndarray:
        """Shingles that every member shares with member x."""
        own = self.shingle[self.begin[x]:self.begin[x + 1]]
        first, count = self.start[own], self.start[own + 1] - self.start[own]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def cell_links(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Links between the members of a cell that fits, by number: enough of them to join all that link."""
    least, base = similar
    reach = 1 - least / base + 1e-9
    held = Postings(sets)
    n, label = held.sizes, np.arange(len(sets))
    waiting, known, out = np.ones(len(sets), bool), [], []
    for x in range(len(sets)):
        waiting[x] = False
        near = waiting & (label != label[x]) & (base * np.minimum(n, n[x]) >= least * np.maximum(n, n[x]))
        for d in known:
            near &= np.abs(d - d[x]) <= reach
        if not near.any():
            continue
        shared = held.common(x)
        united = n + n[x] - shared
        if len(known) < PIVOTS:
            known.append(1 - shared / united)
        for y in np.nonzero(near & (base * shared >= least * united))[0]:
            if label[y] != label[x]:
                out.append((x, int(y)))
                label[label == label[y]] = label[x]
    return out


def joined_cells(members: DataFrame, similar: tuple[int, int], words: int | None = None) -> DataFrame:
    """Links (a, b) inside cells that fit a task: members (cell, class, set), or with ``words`` given (cell, class, packed), of
    which repeated ones count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, held, found = None, [], [], []
        read = unpacked(words) if words else lambda raw: np.frombuffer(raw, np.uint64)

        def close() -> None:
            found.extend((names[x], names[y]) for x, y in (cell_links(held, similar) if len(held) > 1 else ()))

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for here, name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if here != cell:
                    close()
                    cell, names, held = here, [], []
                elif name == names[-1]:
                    continue
                names.append(name)
                held.append(read(raw.as_py()))
            yield sent()
            found.clear()
        close()
        yield sent()

    return members.select("cell", "class", "packed" if words else "set").repartition("cell").sortWithinPartitions("cell", "class").mapInArrow(run, "a long, b long")


def measured(members: DataFrame, pivots: DataFrame, sets: DataFrame, similar: tuple[int, int], block: int) -> DataFrame:
    """(cell, class, n, near): distances of every member of a cell to its pivots (cell, pivot), as a list of (pivot, distance, linked).

    Members are dealt to blocks by hash; a block gets the sets of the cell's few pivots."""
    least, base = similar
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("class"), blocks.cast("long")).cast("int"))
    used = dealt.select("cell", "block").distinct().join(pivots, "cell")
    rows = dealt.select("cell", "block", "class", "n", F.lit(False).alias("is_pivot")).union(
        used.select("cell", "block", "pivot", F.lit(0), F.lit(True)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        heads = [(int(c), np.frombuffer(x, np.uint64)) for c, x in zip(rows["class"][rows["is_pivot"]], rows["set"][rows["is_pivot"]])]
        own = rows[~rows["is_pivot"]]
        near = []
        for raw in own["set"]:
            s, here = np.frombuffer(raw, np.uint64), []
            for c, head in heads:
                shared = len(np.intersect1d(s, head, assume_unique=True))
                united = len(s) + len(head) - shared
                here.append({"pivot": c, "distance": 1 - shared / united, "linked": bool(base * shared >= least * united)})
            near.append(here)
        return pd.DataFrame({"cell": own["cell"], "class": own["class"], "n": own["n"], "near": near})

    return rows.join(sets, "class").select("cell", "block", "class", "n", "is_pivot", "set").groupBy("cell", "block").applyInPandas(
        compare, "cell long, class long, n int, near array<struct<pivot: long, distance: double, linked: boolean>>")


def with_components(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.select(F.col("node").alias("class"), "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))


def open_members(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Members (cell, class, n, comp, ...) that may still link: one of another component and of a size that
    agrees (in the same or a neighbouring band) lies in the cell. With the ``count`` of those that stay."""
    known = members.withColumn("band", size_band("n", similar))
    company = known.groupBy("cell", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    company = company.select("cell", bands_around("band"), "lo", "hi").groupBy("cell", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = known.join(company.filter("lo < hi").select("cell", "band"), ["cell", "band"]).drop("band")
    return with_count(mixed)


def with_count(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("cell").agg(F.count("*").alias("count"), F.sum("n").alias("held"))
    return members.join(sizes, "cell")


def divided(members: DataFrame, sets: DataFrame, links: DataFrame, run: Run, similar: tuple[int, int], fits: int, block: int) -> DataFrame:
    """``links`` (a, b) and those inside cells that do not fit a task: members (cell, class, n, count, held)."""
    least, base = similar
    window = 2 * (1 - least / base) + 1e-9
    level = 0
    while not members.isEmpty():
        place = F.pmod(F.xxhash64("class", F.lit(level)), F.lit(PIVOTS))
        pivots = members.groupBy("cell", place.alias("place")).agg(F.max(F.struct(F.xxhash64("class", F.lit(-1 - level)), "class")).alias("top"))
        pivots = run.store(pivots.select("cell", F.col("top.class").alias("pivot")), f"pivots{level}")
        near = run.store(measured(members, pivots, sets, similar, block), f"measured{level}")
        found = near.select("class", F.inline("near")).filter("linked AND class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
        links = run.store(links.union(found), f"links{level}")
        comps = components(links, run, f"components{level}")
        state = run.store(open_members(with_components(near, comps), similar), f"open{level}")
        small = (F.col("count") <= fits) & (F.col("held") <= HOLDS)
        rest = state.filter(~small).withColumn("nearest", F.array_min(F.transform("near", lambda x: x["distance"])))
        regions = rest.select("cell", "class", "n", "count", "nearest", F.inline("near")).filter(F.col("distance") - F.col("nearest") <= window)
        regions = run.store(regions.select("cell", "pivot", "class", "n", "count"), f"regions{level}")
        pairs = regions.groupBy("cell", "pivot").agg(F.count("*").cast("double").alias("here"), F.first("count").alias("count"))
        pairs = pairs.groupBy("cell").agg(F.sum(F.col("here") * F.col("here")).alias("after"), F.first("count").alias("count"))
        falls = run.store(pairs.filter(F.col("after") < SHRINKS * F.col("count") * F.col("count")).select("cell"), f"falls{level}")
        crowds = rest.join(falls, "cell", "left_anti").withColumn("distances", F.transform("near", lambda x: x["distance"]))
        links = run.store(
            links.union(joined_cells(state.filter(small).join(sets, "class"), similar)).union(in_blocks(crowds, sets, similar, block)), f"more-links{level}")
        again = regions.join(falls, "cell", "left_semi").select(F.xxhash64("cell", "pivot").alias("cell"), "class", "n")
        members = run.store(with_count(again), f"members{level}")
        level += 1
    return links


def in_blocks(members: DataFrame, sets: DataFrame, similar: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members of different components of a cell.

    members: cell, class, n, comp, distances (to the same few pivots of the cell), count (members of the cell);
    sets: class, set. Members are dealt by hash to blocks; every block meets itself and each block after it, and sets join
    the members once these are dealt.
    """
    least, base = similar
    reach = 1 - least / base + 1e-9
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks.cast("long")).cast("int")
    dealt = members.select("cell", "class", "comp", "distances", own.alias("own"), blocks.alias("blocks"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", others).select(
        "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "comp", "distances")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        held = Postings([np.frombuffer(x, np.uint64) for x in rows["set"]])
        n, where = held.sizes, rows["own"].to_numpy()
        label = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        far = np.stack(rows["distances"].to_numpy())
        first = np.nonzero(where == where.min())[0]
        right = where == where.max()
        names, out = rows["class"].to_numpy(), []
        for x in first:
            near = right & (label != label[x]) & (base * np.minimum(n, n[x]) >= least * np.maximum(n, n[x]))
            at = np.nonzero(near)[0]
            at = at[(np.abs(far[at] - far[x]) <= reach).all(axis=1)]
            if not len(at):
                continue
            shared = held.common(x)[at]
            for y in at[base * shared >= least * (n[at] + n[x] - shared)]:
                if label[y] != label[x]:
                    out.append((names[x], names[y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.join(sets, "class").groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, run: Run, words: int = WORDS, similar: tuple[int, int] = SIMILAR,
                    fits: int = FITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null texts and texts without words have no shingles and link with nothing: their component is
    their own doc_id. Rows of one doc_id keep a row each. A row without a doc_id takes part in links and
    gets the least doc_id it reaches, null if there is none.
    """
    first = run.store(sets_and_counts(docs, words), "sets-and-counts")
    named = first.filter("class IS NOT NULL").select("doc_id", "n", "class")
    top = (
        first.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toPandas()
    )
    keys = top["shingle"].to_numpy(np.int64).view(np.uint64)
    by_key = np.argsort(keys)
    frequent = (keys[by_key], top["seen"].to_numpy(np.int64)[by_key])

    shared = run.store(shared_regions(prefixes(docs, frequent, words, similar)), "shared-regions")
    classes = run.store(named.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    members = run.store(cells(shared, classes, similar), "cells")
    run.drop("shared-regions")
    members = run.store(with_count(in_company(members.join(classes, "class"), similar)), "members")
    small = (F.col("count") <= fits) & (F.col("held") <= HOLDS)
    links = run.store(joined_cells(with_texts(docs, members.filter(small), words), similar, words), "links")
    large = run.store(members.filter(~small).drop("rep"), "large")
    if not large.isEmpty():
        wanted = classes.select("class", "rep").join(large.select("class").distinct(), "class")
        sets = run.store(stored_sets(docs, wanted, words), "sets")
        links = divided(large, sets, links, run, similar, fits, block)
    final = components(links, run, "final")

    labelled = classes.join(final, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("comp", "class").alias("comp"))
    lowest = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = run.store(labelled.join(lowest, "comp").select("class", "component_id"), "by-class")
    return (
        named.join(by_class, "class", "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
