"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own shape and that of the lines around it;
neighbouring labels are tied by transition weights. The field is fitted on lines of a bounded
sample of labelled documents, each line bearing its document's label. A document's quality is the
mean of its lines' forward-backward marginals, weighted by their length, brought to the scale of
the labels by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.labelled import labelled_sample, logistic, sigmoid
from frostline.llm.shared import texts
from frostline.llm.tokens import forget

FIT_DOCUMENTS = 6_000    # labelled documents that the field is fitted on, at most
CHAIN = 64               # lines of a chain while fitting; a longer document gives several chains
FIT_CHAINS = 4           # chains of one document that the field is fitted on, at most; scores take every line
ROUNDS = 150
SHRINK = 1e-3
THRESHOLD = 0.3

_LATIN = bytes(range(256))
_UPPER = bytes(c for c in range(256) if chr(c).isupper())
_LOWER = bytes(c for c in range(256) if chr(c).islower())
_DIGIT = b"0123456789"
_STOP = b".,;:'-()"
_SHOUT = b"!?"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP + _SHOUT)
FEATURES = 13


def line_features(line: str, seen_before: bool) -> list[float]:
    """The shape of a line: letters, capitals, digits, marks and signs per character, word length, repetition."""
    raw = line.encode("latin-1", "replace")
    n = len(raw)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    words = line.split()
    k = len(words)
    share = lambda kind: (n - len(raw.translate(None, kind))) / n
    upper, lower = share(_UPPER), share(_LOWER)
    twice = sum(map(operator.eq, words, words[1:]))
    return [
        np.log1p(n) / 5, upper, lower, upper / (upper + lower + 1e-6), share(_DIGIT), share(_STOP), share(_SHOUT), share(_SIGNS),
        min(n / max(k, 1), 30) / 10, 1 - len(set(words)) / max(k, 1), twice / max(k - 1, 1), float(seen_before), 0.0,
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Evidence (lines x features, with the neighbours' beside the line's own) and line lengths."""
    rows, sizes, met = [], [], set()
    for line in text.split("\n"):
        rows.append(line_features(line, line in met and len(line) > 0))
        met.add(line)
        sizes.append(max(1, len(line)))
    own = np.array(rows, np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(own), 2), np.float32)
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, own * own, before, after, edge]), np.array(sizes, float)


@dataclass
class LineField:
    """Two-label field: ``weights`` is the evidence for good, ``ties`` scores (label, next label)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    curve: np.ndarray

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def good(self, x: np.ndarray) -> np.ndarray:
        """Each line's marginal probability of being good."""
        e = self.evidence(x)
        return marginals([e], self.ties)[0][0]

    def quality(self, text: str) -> float:
        x, size = document_features(text)
        return float((self.good(x) * size).sum() / size.sum())

    def score(self, text: str) -> float:
        q = min(max(self.quality(text), 1e-6), 1 - 1e-6)
        return float(sigmoid(self.curve[0] * np.log(q / (1 - q)) + self.curve[1]))


def marginals(chains: list[np.ndarray], ties: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward-backward over all chains at once: P(good) per line, expected (label, next label) counts.

    Chains are walked side by side, longest first, so that step t only touches chains that have a
    line t. Messages are scaled to sum to one.
    """
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    length = np.array([len(chains[i]) for i in order])
    longest = int(length[0])
    local = np.ones((longest, len(order), 2))  # exp(evidence); label 1 is good
    for k, i in enumerate(order):
        e = np.clip(chains[i], -30, 30)
        local[:length[k], k, 1] = np.exp(e / 2)
        local[:length[k], k, 0] = np.exp(-e / 2)
    tie = np.exp(ties)
    alive = [int((length > t).sum()) for t in range(longest)]
    forward, backward = np.ones_like(local), np.ones_like(local)
    forward[0] = local[0] / local[0].sum(1, keepdims=True)
    for t in range(1, longest):
        f = (forward[t - 1, :alive[t]] @ tie) * local[t, :alive[t]]
        forward[t, :alive[t]] = f / f.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        b = (backward[t + 1, :alive[t + 1]] * local[t + 1, :alive[t + 1]]) @ tie.T
        backward[t, :alive[t + 1]] = b / b.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(2, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1):
        m = alive[t + 1]
        joint = forward[t, :m, :, None] * tie * (local[t + 1, :m] * backward[t + 1, :m])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    out: list = [None] * len(chains)
    for k, i in enumerate(order):
        out[i] = both[:length[k], k, 1]
    return out, pairs


def fit_field(chains: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, shrink: float = SHRINK) -> LineField:
    """Maximum conditional likelihood with Adam steps; every line of a chain bears the chain's label."""
    every = np.concatenate(chains)
    mean, spread = every.mean(0), every.std(0) + 1e-3
    x = np.hstack([(every - mean) / spread, np.ones((len(every), 1))])
    cuts = np.cumsum([len(c) for c in chains])[:-1]
    y = np.repeat(labels, [len(c) for c in chains]).astype(float)
    seen = np.zeros((2, 2))
    for c, label in zip(chains, labels):
        seen[int(label), int(label)] += len(c) - 1
    n = len(every)
    w, ties = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta = np.concatenate([w, ties.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, ties = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = marginals(np.split(x @ w, cuts), ties)
        slope = np.concatenate([x.T @ (np.concatenate(good) - y) / n, ((pairs - seen) / n).ravel()]) + shrink * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), np.array([1.0, 0.0]))


def sampled_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and lengths of a document's lines; of more than ``FIT_CHAINS`` chains those with the least hashes, in order."""
    x, size = document_features(text)
    chains = -(-len(x) // CHAIN)
    if chains <= FIT_CHAINS:
        return x, size
    own = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    chosen = sorted(sorted(range(chains), key=lambda k: (zlib.crc32(b"%d:%d" % (own, k)), k))[:FIT_CHAINS])
    rows = np.concatenate([np.arange(k * CHAIN, min((k + 1) * CHAIN, len(x))) for k in chosen])
    return x[rows], size[rows]


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, bound: int = FIT_DOCUMENTS) -> LineField | None:
    """The field and its curve; None where the sample does not hold both labels.

    Chains of the sample come to the driver as numbers: at most ``bound`` documents, ``FIT_CHAINS`` chains of each, whatever
    their length."""
    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, size = sampled_lines(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()], pa.int32()), pa.array([len(x)], pa.int32()),
                    pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([size.astype("<f4").tobytes()], pa.binary())],
                    names=["y", "lines", "x", "size"])

    sample = labelled_sample(docs, labels, "quality", may_learn, bound).select("y", "text")
    got = sample.mapInArrow(chains, "y int, lines int, x binary, size binary").toPandas()
    if got["y"].nunique() < 2:
        return None
    got = got.sort_values(["lines", "y", "x"])  # the same order of sums however the rows arrive
    whole = [np.frombuffer(x, "<f4").reshape(n, -1) for x, n in zip(got["x"], got["lines"])]
    parts = [(x[a:a + CHAIN], y) for x, y in zip(whole, got["y"]) for a in range(0, len(x), CHAIN)]
    field = fit_field([p for p, _ in parts], np.array([y for _, y in parts]))
    q = np.array([(field.good(x) * (s := np.frombuffer(size, "<f4"))).sum() / s.sum() for x, size in zip(whole, got["size"])])
    q = np.clip(q, 1e-6, 1 - 1e-6)
    field.curve = logistic(np.log(q / (1 - q))[:, None], got["y"].to_numpy(float), np.array([0.5, 0.0]), 1.0)
    return field


def score(docs: DataFrame, field: LineField | None, name: str = "score") -> DataFrame:
    """(columns of ``docs``, ``name``): probability that each whole text is good; 0.5 without a field.

    Null and empty texts are one empty line. """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        known = held.value
        for batch in batches:
            yield pd.Series([0.5 if known is None else known.score(t or "") for t in batch], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(rate, "double")(F.coalesce(docs["text"], F.lit(""))))


def score_texts(docs: DataFrame, field: LineField | None) -> DataFrame:
    return score(texts(docs), field).select("doc_id", "score")
