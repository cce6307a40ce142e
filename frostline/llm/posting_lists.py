"""Approximate nearest neighbours by balanced posting lists.

Centroids of balanced clusters lie in memory with a neighbourhood graph over them; the vectors lie in
one posting list per centroid. A vector near a border is replicated to several lists: those
whose centroid is hardly farther than the nearest, leaving out centroids that lie beside one already chosen.

A query knows a bound on the distance of its k-th neighbour, from the sample that the centroids are fitted
on. It searches the graph and reads the lists whose centroid is farther than the nearest by at most
a share of that bound. At a share of 2 no neighbour can be lost; the share of a table is the least that finds
``RECALL`` of the neighbours inside the sample, whose neighbours are farther than those of the whole table.
Lists of near centroids make a region, to which a query goes once. Regions are read in blocks of bounded size,
so a list of very many equal vectors is the work of many tasks; distances are exact, on the original vectors
in double precision.

Centroids are fitted on at most ``SAMPLE`` vectors chosen by hash; every vector is indexed. Their
number is bounded by ``MOST_LISTS``, which bounds what each task holds in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.shared import Run

SAMPLE = 20_000
LIST_SIZE = 200            # vectors a list should hold
MOST_LISTS = 1024
REPLICAS = 4
BORDER = 1.01              # a vector joins lists up to this ratio of its nearest centroid's distance
BESIDE = 0.25              # but none whose centroid is nearer to one already joined than this share of its distance
DEGREE = 16                # graph neighbours of a centroid
BEAM = 48                  # centroids a search keeps; a query's search goes on until it has passed its limit
RECALL = 0.95              # share of the neighbours inside the sample that the lists read must hold
ASKED = 256                # vectors of the sample whose neighbours set the limit
REGION = 8                 # lists of a region
BLOCK = 2048               # vectors of a region that one task group reads
QUERIES = 16_384           # queries that one task group reads, about


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose assignment is charged for the size a cluster already has."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centre = distinct[rng.choice(len(distinct), k, replace=False)]
    size, fair = np.zeros(k), len(x) / k
    for _ in range(rounds):
        d = distances(x, centre)
        charge = 0.1 * np.median(d.min(1)) if len(d) else 0.0
        own = np.argmin(d + charge * np.maximum(size / fair - 1, 0), axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


@dataclass
class CentroidGraph:
    """Centroids with their nearest neighbours as edges, both ways, and spread entry points."""

    centre: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centre: np.ndarray, degree: int = DEGREE) -> CentroidGraph:
        k = len(centre)
        near = np.argsort(distances(centre, centre), axis=1, kind="stable")[:, 1:degree + 1]
        links = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row[:degree // 2]:
                links[j].add(i)
        width = max(map(len, links), default=0) or 1
        edges = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(links)], np.int64).reshape(k, width)
        # farthest-first entry points, so that every part of the graph is reached
        entry, far = [0], distances(centre, centre[:1])[:, 0]
        while len(entry) < min(8, k):
            entry.append(int(np.argmax(far)))
            far = np.minimum(far, distances(centre, centre[entry[-1:]])[:, 0])
        return cls(centre, edges, np.array(entry))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``beam`` centroids that a best-first walk finds for each row, nearest first.

        All rows walk together: in each step every row expands the nearest four centroids of its
        beam that it has not expanded yet, until no beam holds one.
        """
        m, k = len(x), len(self.centre)
        beam = min(beam, k)
        found = np.full((m, k), np.inf)
        found[:, self.entries] = distances(x, self.centre[self.entries])
        done = np.zeros((m, k), bool)
        norm = (self.centre * self.centre).sum(1)
        own = (x * x).sum(1)
        rows = np.arange(m)
        while len(rows):
            part = found[rows]
            limit = np.partition(part, beam - 1, axis=1)[:, beam - 1]
            part = np.where(done[rows] | (part > limit[:, None]) | np.isinf(part), np.inf, part)
            take = min(4, k)
            best = np.argpartition(part, take - 1, axis=1)[:, :take]
            live = np.isfinite(np.take_along_axis(part, best, 1))
            going = live.any(1)
            rows, best, live = rows[going], best[going], live[going]
            if not len(rows):
                break
            r, c = np.nonzero(live)
            done[rows[r], best[r, c]] = True
            node = self.edges[best[r, c]]
            who = np.repeat(rows[r], node.shape[1])
            node = node.ravel()
            new = np.isinf(found[who, node])
            who, node = who[new], node[new]
            dot = np.einsum("ij,ij->i", x[who], self.centre[node])
            found[who, node] = np.sqrt(np.maximum(own[who] + norm[node] - 2 * dot, 0))
        order = np.argsort(found, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(found, order, 1)


def side_by_side(centre: np.ndarray) -> np.ndarray:
    """An order of the centroids in which every ``REGION`` of them lie near each other: halved along the widest axis."""
    def halve(part: np.ndarray) -> list[np.ndarray]:
        if len(part) <= REGION:
            return [part]
        x = centre[part] - centre[part].mean(0)
        part = part[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        half = (len(part) // REGION + 1) // 2 * REGION
        return halve(part[:half]) + halve(part[half:])

    return np.concatenate(halve(np.arange(len(centre))))


@dataclass
class Index:
    """The centroids' graph, a sample of the vectors with the lists they are in, and the share of a query's bound it reads by.

    ``at`` holds the lists of the sampled vectors one after the other, those of vector i from ``start[i]`` on.
    """

    graph: CentroidGraph
    ids: np.ndarray
    sample: np.ndarray
    at: np.ndarray
    start: np.ndarray
    share: float = 2.0

    def others(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distances to the sampled vectors of other ids, about; infinite to the own."""
        far = distances(x, self.sample)
        far[ids[:, None] == self.ids] = np.inf
        return far

    def bound(self, x: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
        """What the distance of the k-th of those with finite ``far`` cannot pass; infinite if there are fewer."""
        if len(self.sample) < k:
            return np.full(len(x), np.inf)
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        exact = np.sqrt(((self.sample[near] - x[:, None]) ** 2).sum(2))
        return np.where(np.isinf(np.take_along_axis(far, near, 1)), np.inf, exact).max(1)

    def lists(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each row and list whether the row reads the list."""
        count, rows, beam = len(self.graph.centre), np.arange(len(x)), BEAM
        read = np.zeros((len(x), count), bool)
        limit = None
        while len(rows):
            node, far = self.graph.search(x[rows], beam)
            if limit is None:
                limit = far[:, 0] + self.share * bound
            read[rows[:, None], node] = far <= limit[rows, None]
            rows = rows[far[:, -1] <= limit[rows]] if beam < count else rows[:0]
            beam *= 4
        return read

    def choose(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists each row reads, and a distance that k of the vectors in them do not pass."""
        far = self.others(ids, x)
        read = self.lists(x, self.bound(x, far, k))
        if len(self.sample):
            inside = np.logical_or.reduceat(read[:, self.at], self.start, axis=1) & np.isfinite(far)
            few = np.flatnonzero(inside.sum(1) < k)
            if len(few):  # further lists in centroid order until k others are certain
                order = np.argsort(distances(x[few], self.graph.centre), axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                first = np.minimum.reduceat(place[:, self.at], self.start, axis=1)
                first = np.sort(np.where(np.isfinite(far[few]), first, read.shape[1]), axis=1)
                last = first[:, k - 1] if first.shape[1] >= k else np.full(len(few), read.shape[1])
                read[few] |= place <= last[:, None]
                inside = np.logical_or.reduceat(read[:, self.at], self.start, axis=1) & np.isfinite(far)
            far[~inside] = np.inf
        else:
            read[:] = True
        return read, self.bound(x, far, k)

    def least_share(self, k: int, recall: float) -> float:
        """The least share of the bound at which ``recall`` of the neighbours inside the sample are read."""
        if len(self.sample) <= k:
            return 2.0
        asked = np.random.default_rng(5).choice(len(self.sample), min(ASKED, len(self.sample)), replace=False)
        x = self.sample[asked]
        far = self.others(self.ids[asked], x)
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        bound = np.take_along_axis(far, near, 1).max(1)
        to_list = distances(x, self.graph.centre)
        to_own = np.minimum.reduceat(to_list[:, self.at], self.start, axis=1)
        need = np.take_along_axis(to_own, near, 1) - to_list.min(1)[:, None]
        apart = bound > 1e-6 * np.sqrt((x * x).sum(1))  # copies are in one list anyway
        return float(np.clip(np.quantile(need[apart] / bound[apart, None], recall), 1e-3, 2.0)) if apart.any() else 2.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows whose vector is neither null nor zero and holds only finite numbers.

    Vectors of another length than most take no part either, nor do rows without an id."""
    infinite = F.lit(float("inf"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(whole)
    common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return kept.join(common, F.size("v") == F.col("d")).drop("d")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def chosen(vec_id: Column, count: int, sample: int) -> Column:
    return F.pmod(F.xxhash64(vec_id, F.lit(11)), F.lit(1_000_000)) < F.lit(max(1, int(1e6 * min(1, sample / count))))


def fit(rows: DataFrame, count: int, sample: int = SAMPLE, list_size: int = LIST_SIZE, most_lists: int = MOST_LISTS) -> tuple[CentroidGraph, np.ndarray, np.ndarray]:
    """Graph of centroids from a sample of bounded size, and the sample's ids and vectors."""
    part = rows.filter(chosen(F.col("vec_id"), count, sample)).limit(2 * sample).toArrow()
    if not len(part):
        part = rows.limit(sample).toArrow()
    x = matrix(part["v"].combine_chunks())
    centre = balanced_centroids(x, max(1, min(most_lists, round(count / list_size))))
    return CentroidGraph.build(centre[side_by_side(centre)]), part["vec_id"].to_numpy(), x


def indexed(lists: DataFrame, graph: CentroidGraph, ids: np.ndarray, x: np.ndarray, count: int, k: int, recall: float, sample: int = SAMPLE) -> Index:
    """The index with the lists that the sampled vectors were posted to. Ids with several vectors bound nothing."""
    posted = lists.filter(chosen(F.col("vec_id"), count, sample)).select("vec_id", "list").distinct().toArrow()
    names, first, of = np.unique(ids, return_index=True, return_inverse=True)
    single = np.ones(len(names), bool)
    np.logical_and.at(single, of, (x == x[first][of]).all(1))
    who, at = posted["vec_id"].to_numpy(), posted["list"].to_numpy()
    single &= np.isin(names, who)
    names, x = names[single], x[first[single]]
    part = np.isin(who, names)
    order = np.lexsort((at[part], who[part]))
    who, at = who[part][order], at[part][order]
    index = Index(graph, names, x, at, np.searchsorted(who, names))
    index.share = index.least_share(k, recall)
    return index


def post(rows: DataFrame, graph, replicas: int = REPLICAS, border: float = BORDER) -> DataFrame:
    """(list, vec_id, v): every vector in its list and, near a border, in others."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: CentroidGraph = graph.value
        between = distances(g.centre, g.centre)
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                node, far = g.search(matrix(part.column(1)), BEAM)
                keep = far <= border * far[:, :1]
                keep[:, 0] = True
                for c in range(1, keep.shape[1]):  # not beside a list that the vector already joins
                    if not keep[:, c].any():
                        break
                    beside = ((between[node[:, :c], node[:, c:c + 1]] < BESIDE * far[:, c:c + 1]) & keep[:, :c]).any(1)
                    keep[:, c] &= ~beside & (keep[:, :c].sum(1) < replicas)
                r, c = np.nonzero(keep)
                copies = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(node[r, c].astype(np.int32)), *copies.columns], names=["list", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(assign, "list int, vec_id long, v array<double>")


def probe(queries: DataFrame, index, k: int) -> DataFrame:
    """(region, reads, query_id, q, bound): the regions that each query reads, with a bit for each list it reads there."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                x = matrix(part.column(1))
                read, bound = found.choose(part.column(0).to_numpy(), x, k)
                read = np.pad(read, ((0, 0), (0, -read.shape[1] % REGION))).reshape(len(x), -1, REGION)
                bits = (read << np.arange(REGION)).sum(2)
                r, c = np.nonzero(bits)
                asked = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int32)), pa.array(bits[r, c].astype(np.int32)), *asked.columns, pa.array(bound[r])],
                    names=["region", "reads", "query_id", "q", "bound"])

    return queries.select("vec_id", "v").mapInArrow(choose, "region int, reads int, query_id long, q array<double>, bound double")


def nearest(vectors: DataFrame, is_query, run: Run, k: int = 10, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, its own id left out.

    Ties go to the smaller vec_id; rows of one vec_id count once, at their smallest distance. Queries whose
    vector takes no part give no rows, nor does a table without candidates.
    """
    rows = run.store(usable(vectors), "vectors")
    count = rows.count()
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    graph, ids, sample = fit(rows, count)
    broadcast = rows.sparkSession.sparkContext.broadcast
    lists = run.store(post(rows, broadcast(graph)), "lists")
    index = broadcast(indexed(lists, graph, ids, sample, count, k, recall))
    queries = rows.filter(is_query(F.col("vec_id")))
    turns = -(-queries.count() // QUERIES) or 1
    lists = lists.withColumn("region", F.floor(F.col("list") / F.lit(REGION)).cast("int"))
    sizes = lists.groupBy("region").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).select("region", "blocks")
    dealt = (
        lists.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    )
    asked = (
        probe(queries, index, k).join(sizes, "region")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        .withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    )

    def read(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            x, ids, of = np.stack(members["v"]), members["vec_id"].to_numpy(), members["list"].to_numpy() % REGION
            for a in range(0, len(queries), 64):
                part = queries.iloc[a:a + 64]
                q, own, bound = np.stack(part["q"]), part["query_id"].to_numpy(), part["bound"].to_numpy()
                wide = bound + 1e-6 * np.sqrt((q * q).sum(1) + (x * x).sum(1).max())  # products round, differences decide
                r, c = np.nonzero((part["reads"].to_numpy()[:, None] >> of & 1).astype(bool) & (distances(q, x) <= wide[:, None]) & (own[:, None] != ids))
                far = np.sqrt(((x[c] - q[r]) ** 2).sum(1))
                near = pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": far})[far <= bound[r] * (1 + 1e-9)]
                near = near.sort_values(["score", "vec_id"]).drop_duplicates(["query_id", "vec_id"])
                out.append(near.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ("region", "part", "turn")
    near = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(read, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
