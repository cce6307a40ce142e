"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, or other. Three transducers
are composed into one: negation marks what stands in its scope, reported speech what follows it in the
clause, targets what they are near. Each matched insult or threat leaves the grammar with the
marks it met on the way, so a quoted or negated word counts as another event than one thrown at somebody.
A document's events, weighted by the lexicon, add up in a logistic score.

The grammar's shape and first weights are fixed; which words and word stems insult, and how much each
kind of event says, is learned from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.labelled import labelled_sample, logistic, sigmoid
from frostline.llm.shared import texts

FIT_DOCUMENTS = 10_000     # labelled documents that words and weights are learned from, at most
MOST_ENTRIES = 5_000       # learned words and stems, strongest first
STEMS = (4, 5, 6, 7)       # letters of a stem
THRESHOLD = 0.3
KNOWN_WORDS = 400_000      # words a worker remembers before it starts anew

# Words by their part in the grammar.
INSULTS = "idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting imbecile vermin filth".split()
THREATS = "kill hurt destroy murder attack stab shoot punch beat töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they him her them people du dich dir ihr euch tu te toi vous vos tú ti usted ustedes".split()
NEGATIONS = "not never cannot neither nicht kein keine niemals jamais nunca".split()
REPORTS = "said says say called calls wrote writes quoted quote claimed told sagte sagt schrieb disait écrit dijo dice escribió".split()

SYMBOLS = "wITYNR"         # other, insult, threat, target, negation, report
EVENTS = [kind + neg + rep + tar for kind in "IT" for neg in ("", "-") for rep in ("", "q") for tar in ("", "+")]
# First weights of the events: kind, and what each mark adds.
PRIOR = {"I": 3.0, "T": 1.0, "-": -2.0, "q": -1.5, "+": 1.0}
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.,;:!?\n()\"]+")


@dataclass
class Transducer:
    """A finite-state transducer: ``arcs[state, symbol]`` is (next state, output)."""

    start: object
    arcs: dict = field(default_factory=dict)

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one puts out is what ``other`` reads."""
        made = Transducer((self.start, other.start))
        waiting, met = deque([made.start]), {made.start}
        inputs: dict = {}
        for (state, symbol), arc in self.arcs.items():
            inputs.setdefault(state, []).append((symbol, arc))
        while waiting:
            a, b = waiting.popleft()
            for symbol, (a2, middle) in inputs.get(a, []):
                if (b, middle) in other.arcs:
                    b2, out = other.arcs[b, middle]
                    made.arcs[(a, b), symbol] = ((a2, b2), out)
                    if (a2, b2) not in met:
                        met.add((a2, b2))
                        waiting.append((a2, b2))
        return made

    def run(self, symbols: str) -> Iterator[str]:
        state = self.start
        for s in symbols:
            state, out = self.arcs[state, s]
            yield out


def scope(opener: str, mark: str, reach: int, symbols: list[str]) -> tuple[Transducer, list[str]]:
    """Marks insults and threats up to ``reach`` words behind ``opener``; also the symbols it puts out."""
    made, out = Transducer(0), set()
    for left in range(reach + 1):
        for s in symbols:
            event = s[0] in "IT" and left > 0
            written = s + mark if event else s
            made.arcs[left, s] = (reach if s == opener else max(0, left - 1), written)
            out.add(written)
    return made, sorted(out)


def grammar() -> Transducer:
    """Negation (3 words), then reported speech (8 words), then targets (4 words)."""
    symbols, made = list(SYMBOLS), None
    for opener, mark, reach in (("N", "-", 3), ("R", "q", 8), ("Y", "+", 4)):
        part, symbols = scope(opener, mark, reach, symbols)
        made = part if made is None else made.then(part)
    return made


FIXED = {w: s for words, s in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "Y"), (THREATS, "T"), (INSULTS, "I")) for w in words}


@dataclass
class Model:
    """Lexicon weights of insulting words and stems, and the weights of events; the last is the bias."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray

    def __post_init__(self):
        self.grammar, self.known = grammar(), {}
        self.columns = {e: i for i, e in enumerate(EVENTS)}

    def symbol(self, word: str) -> tuple[str, float]:
        """A word's part in the grammar and its weight."""
        if word in self.words:
            return "I", self.words[word]
        for n in STEMS:
            if word[:n] in self.stems and len(word) > n:
                return "I", self.stems[word[:n]]
        return FIXED.get(word, "w"), 1.0

    def events(self, text: str) -> np.ndarray:
        """Weighted events of the whole text, by kind and marks."""
        out = np.zeros(len(EVENTS))
        low = text.lower()
        hit = False
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        for word in set(WORD.findall(low)):
            found = self.known.get(word)
            if found is None:
                found = self.known[word] = self.symbol(word)
            hit = hit or found[0] in "IT"
        if not hit:
            return out
        for clause in CLAUSE.split(low):
            parts = [self.known[w] for w in WORD.findall(clause)]
            symbols = "".join(s for s, _ in parts)
            if "I" not in symbols and "T" not in symbols:
                continue
            # a target behind the word counts as one before it: the clause is read both ways for targets
            there, back = list(self.grammar.run(symbols)), list(self.grammar.run(symbols[::-1]))[::-1]
            for (s, weight), a, b in zip(parts, there, back):
                if s in "IT":
                    marked = a if a.endswith("+") or not b.endswith("+") else a + "+"
                    out[self.columns[marked]] += weight
        return out

    def score(self, text: str) -> float:
        return float(sigmoid(np.log1p(self.events(text)) @ self.weights[:-1] + self.weights[-1]))


def first_weights() -> np.ndarray:
    return np.array([sum(PRIOR[c] for c in e) for e in EVENTS] + [-3.0])


def lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic documents far more often than others; bounded by ``MOST_ENTRIES``.

    Document frequencies are counted over the whole sample. A stem must carry several words, so that it
    speaks for forms not met yet; words under an accepted stem need no entry.
    """
    words = (
        sample.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter("length(w) > 2")
        .groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    )
    totals = sample.groupBy("y").count().collect()
    toxic, clean = ({r["y"]: r["count"] for r in totals}.get(k, 0) for k in (1, 0))
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1))
    enough = F.col("t") >= F.lit(max(6, 0.004 * toxic))
    strong = lambda df: df.withColumn("odds", odds).filter(enough & (F.col("odds") > 3)).orderBy(F.desc("odds"), "w").limit(MOST_ENTRIES).collect()
    stems = words.filter(F.length("w") > min(STEMS)).select(
        F.explode(F.filter(F.array(*[F.substring("w", 1, n) for n in STEMS]), lambda p: F.length(p) < F.length("w"))).alias("w"), "t", "c")
    stems = stems.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("forms")).filter("forms >= 5 AND c <= 0.02 * t")
    chosen: dict[str, float] = {}
    for r in sorted(strong(stems), key=lambda r: len(r["w"])):
        if not any(r["w"][:n] in chosen for n in STEMS):
            chosen[r["w"]] = min(1.0, r["odds"] / 6)
    single = {r["w"]: min(1.0, r["odds"] / 6) for r in strong(words) if not any(r["w"][:n] in chosen for n in STEMS)}
    return single, chosen


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, bound: int = FIT_DOCUMENTS) -> Model:
    """Lexicon and event weights; the fixed insults and first weights alone where no toxic label is."""
    sample = labelled_sample(docs, labels, "toxic", may_learn, bound).select("y", "text").persist()
    words, stems = lexicon(sample)
    model = Model({w: 1.0 for w in INSULTS} | words, stems, first_weights())
    held = docs.sparkSession.sparkContext.broadcast(model)

    def events(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([held.value.events(t).tolist() for t in batch])

    got = sample.select("y", F.pandas_udf(events, "array<double>")("text").alias("e")).toPandas()  # 17 numbers a row of the sample
    sample.unpersist()
    if got["y"].nunique() == 2:
        x, y = np.log1p(np.stack(got["e"])), got["y"].to_numpy(float)
        order = np.lexsort([*x.T, y])
        model.weights = logistic(x[order], y[order], first_weights(), 2.0)
    return Model(model.words, model.stems, model.weights)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """(columns of ``docs``, ``name``): probability that each whole text is toxic. Null texts are empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([held.value.score(t or "") for t in batch], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(rate, "double")(F.coalesce(docs["text"], F.lit(""))))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    return score(texts(docs), model).select("doc_id", "score")
