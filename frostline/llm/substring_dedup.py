"""Repeated substrings by seed and extend: words that an earlier window of equal words covers.

A window is ``WINDOW`` consecutive words. It repeats if the same words also start earlier: in a document of
smaller id, or further ahead in the same text. All words of repeated windows are removed; adjoining
repeated windows make a maximal repeat, which is at least one window long.

1. Seeds. Every window has one anchor, the least hash among its runs of ``SEED`` words (winnowing), so
   equal windows have equal anchors. Neighbouring windows mostly share theirs: a stretch is the longest row of
   windows of one anchor, and a text has about one for every seven words. Windows that repeat inside their
   own text are known at once and belong to no stretch.
2. Join. Stretches meet on their anchor. Of equal stretches only the document of the smallest id
   keeps it, the others lose it whole: long matches extend over as many stretches as they run through.
3. Extend. Where an anchor is shared by different stretches, a match begins, ends or breaks inside them. Of these, and only of
   these, every window to the left and right of the seed is compared: it repeats if a document of smaller id has it.

A group of copies costs one row per copy, never its pairs. A task sends no more than one stretch per anchor to
the join and one row per window to the extension, whatever an anchor's share of the rows: what it has met itself
it settles itself. Windows and stretches are compared by 64-bit hashes.

Null texts and texts without words have none. A text of fewer words than a window loses nothing. Rows that repeat a
doc_id are separate texts of which neither is earlier. Rows without a doc_id come after all others,
among themselves in the order of a hash of their texts. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run, texts
from frostline.llm.tokens import forget
from frostline.llm.words import WordHasher, grams, mix, sliding_least, sums

WINDOW = 20
SEED = 8
HELD = 1_000_000           # stretches or windows that a task settles at once


class Stretches:
    """The windows of one text: ``hash`` of each, whether it came ``before`` in the text, and its stretches."""

    def __init__(self, words: np.ndarray, window: int, seed: int):
        total = sums(words)
        self.hash = grams(total, window)
        n = len(self.hash)
        self.before = np.zeros(n, bool)
        self.first = self.last = np.zeros(0, np.int64)   # stretch k holds the windows first[k] to last[k] - 1
        self.anchor = self.name = np.zeros(0, np.uint64)
        if not n:
            return
        order = np.argsort(self.hash, kind="stable")
        ordered = self.hash[order]
        self.before[order[1:]] = ordered[1:] == ordered[:-1]
        anchor = sliding_least(grams(total, seed), window - seed + 1)
        begins = np.ones(n, bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (self.before[1:] != self.before[:-1])
        first = np.nonzero(begins)[0]
        last = np.append(first[1:], n)
        fresh = ~self.before[first]
        self.first, self.last = first[fresh], last[fresh]
        self.anchor = anchor[self.first]
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash, out=run[1:])
        self.name = mix(run[self.last] - run[self.first] + mix((self.last - self.first).astype(np.uint64)))

    def windows_of(self, names: np.ndarray) -> np.ndarray:
        """Whether each window lies in a stretch of one of these names."""
        inside = np.zeros(len(self.hash) + 1, np.int64)
        found = np.isin(self.name, names)
        np.add.at(inside, self.first[found], 1)
        np.add.at(inside, self.last[found], -1)
        return np.cumsum(inside[:-1]) > 0


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Marks where sorted keys differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sources(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): ``doc`` orders the texts and names them in joins."""
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    return texts(docs).withColumn("doc", F.coalesce("doc_id", unnamed))


def stretches(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Seeds, settled inside each task: (anchor, name, doc, mixed, kind) with the kinds

    ``join``: one stretch per anchor, for the join; ``mixed`` tells that the task met others of this anchor.
    ``gone``: the document loses the stretch, a smaller id has it. ``open``: windows must be compared.
    """
    columns = ["anchor", "name", "doc", "mixed", "kind"]

    def settle(parts: list[tuple]) -> pa.RecordBatch:
        anchor, name, doc = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, name, anchor))
        anchor, name, doc = anchor[order], name[order], doc[order]
        new_anchor, new_name = first_of_each(anchor), first_of_each(anchor, name)
        group, stretch = np.cumsum(new_anchor) - 1, np.cumsum(new_name) - 1
        mixed = np.bincount(group, weights=new_name)[group] > 1
        gone = doc > doc[new_name][stretch]
        sent = [(np.nonzero(new_anchor)[0], "join"), (np.nonzero(gone)[0], "gone"), (np.nonzero(new_name & mixed)[0], "open")]
        rows = np.concatenate([at for at, _ in sent])
        kinds = pa.DictionaryArray.from_arrays(np.repeat(np.arange(3, dtype=np.int8), [len(at) for at, _ in sent]), [k for _, k in sent])
        return pa.RecordBatch.from_arrays(
            [_signed(anchor[rows]), _signed(name[rows]), pa.array(doc[rows]), pa.array(mixed[rows]), kinds.cast(pa.string())], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher, parts, held = WordHasher(), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(2).to_pylist(), batch.column(1)):
                _, _, words = hasher.words(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8))
                found = Stretches(words, window, seed)
                if len(found.name):
                    parts.append((found.anchor, found.name, np.full(len(found.name), doc)))
                    held += len(found.name)
                if held >= HELD:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    return sources(docs).mapInArrow(run, "anchor long, name long, doc long, mixed boolean, kind string")


def joined(met: DataFrame) -> DataFrame:
    """(doc, name, gone): stretches that their document loses whole, and others whose windows must be compared."""
    here, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "name")
    sent = met.filter("kind = 'join'").select(
        "anchor", "name", "doc", F.min("doc").over(same).alias("earliest"),
        (F.max("mixed").over(here) | (F.min("name").over(here) < F.max("name").over(here))).alias("shared"))
    sent = sent.select("doc", "name", (F.col("doc") > F.col("earliest")).alias("gone"), "shared").filter("gone OR shared")
    settled = met.filter("kind <> 'join'").select("doc", "name", (F.col("kind") == "gone").alias("gone"))
    return sent.select("doc", "name", "gone").union(settled)


def extended(named: DataFrame, wanted: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc, name): windows of open stretches that a smaller id has too, among the texts ``named`` (doc_id, text, doc).

    ``wanted`` (doc, names) lists the open stretches of each document."""
    def settle(parts: list[tuple]) -> pa.RecordBatch:
        name, doc = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = first_of_each(name)
        gone = doc > doc[new][np.cumsum(new) - 1]
        rows = new | gone & first_of_each(name, doc)
        return pa.RecordBatch.from_arrays([_signed(name[rows]), pa.array(doc[rows]), pa.array(gone[rows])], names=["name", "doc", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = WordHasher(), [], 0
        for batch in batches:
            place = {c: batch.schema.get_field_index(c) for c in ("doc", "text", "names")}
            for doc, text, names in zip(*(batch.column(place[c]) for c in ("doc", "text", "names"))):
                _, _, words = hasher.words(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8))
                found = Stretches(words, window, seed)
                compared = found.hash[found.windows_of(names.values.to_numpy().view(np.uint64))]
                parts.append((compared, np.full(len(compared), doc.as_py())))
                held += len(compared)
                if held >= HELD:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    seen = named.join(wanted, "doc").mapInArrow(run, "name long, doc long, gone boolean")
    earliest = F.min("doc").over(Window.partitionBy("name"))
    return seen.withColumn("gone", F.col("gone") | (F.col("doc") > earliest)).filter("gone").select("doc", "name")


def repeats(docs: DataFrame, run: Run, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: the maximal repeats [first, last) in words, and
    the text left without them, its words joined by one space."""
    if not 0 < seed <= window:
        raise ValueError("a seed lies inside a window")
    met = run.store(stretches(docs, window, seed), "stretches")
    marks = run.store(joined(met), "marks")
    run.drop("stretches")
    named = sources(docs)
    wanted = marks.filter("NOT gone").groupBy("doc").agg(F.collect_set("name").alias("names"))
    lost = marks.filter("gone").select("doc", "name").union(extended(named, wanted, window, seed))
    lost = lost.groupBy("doc").agg(F.collect_set("name").alias("names"))  # a text's own stretches and windows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            place = {c: batch.schema.get_field_index(c) for c in ("doc_id", "text", "names")}
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for text, names in zip(part.column(place["text"]), part.column(place["names"])):
                    known = names.values.to_numpy().view(np.uint64) if names.is_valid else np.zeros(0, np.uint64)
                    rows.append(without_repeats(text.as_py(), known, hasher, window, seed))
                words, removed, spans, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(place["doc_id"]), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return named.join(lost, "doc", "left").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, spans array<struct<first: long, last: long>>, kept string")


def without_repeats(text: str, names: np.ndarray, hasher: WordHasher, window: int, seed: int) -> tuple:
    """Words, removed words, spans and kept text, given the names of lost stretches and windows."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    start, end, words = hasher.words(raw)
    n = len(words)
    found = Stretches(words, window, seed)
    cover = np.zeros(n + 1, np.int64)
    if len(found.hash):
        lost = found.before.copy()
        if len(names):
            lost |= found.windows_of(names) | np.isin(found.hash, names)
        at = np.nonzero(lost)[0]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover[:n]) > 0
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    spans = [{"first": int(a), "last": int(b)} for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]
    # every word is followed by a gap byte, which becomes the space between kept words
    letters = np.zeros(len(raw) + 1, np.int64)
    np.add.at(letters, start[~gone], 1)
    np.add.at(letters, end[~gone] + 1, -1)
    single = raw.copy()
    single[end] = 32
    kept = single[np.cumsum(letters[:-1]) > 0].tobytes()[:-1].decode("utf-8", "surrogatepass")
    return n, int(gone.sum()), spans, kept
