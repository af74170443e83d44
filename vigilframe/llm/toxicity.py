"""Toxicity: a learnt lexicon found under misspellings, weighed by the words around each hit.

The lexicon holds words, and stems of four to six letters, that mark toxic documents. Levenshtein
automata of its terms, intersected with its trie, run over each different word once; states of
the product are made as words ask for them. A hit counts as quoted if quotation marks surround
it, its line is quoted, or a word of reporting is near; else as direct, and as aimed if a word
of address is near. A logistic model weighs these counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import Memo, settle, slices

STEMS = (4, 5, 6)  # letters of a stem
WINDOW = 6  # words on either side of a hit
SHORTEST = 4  # letters of a term that may be misspelt
EDGE = ".,;:!?\"'`()[]{}<>*#$%&|_-/\\…«»“”„‘’¡¿"
QUOTES = frozenset("\"«»“”„")
# Words of reporting and of address in the languages served.
REPORTING = frozenset("said says wrote writes called calls quoted quote quoting dijo escribió citó llamó dit écrit cite appelé sagte schrieb zitierte nannte".split())
ADDRESS = frozenset("you your you're u ur yourself tú tu usted ustedes te vous toi ton votre du dich dir ihr euch".split())
FEATURES = 6


def edits_of(term: str) -> int:
    """Misspellings a term allows: none for stems and words under four letters, one, or two from ten letters on."""
    if term.endswith("*") or len(term) < SHORTEST:
        return 0
    return 1 if len(term) < 10 else 2


class Automaton:
    """Product of the terms' Levenshtein automata and the terms' trie, made deterministic lazily.

    A state maps trie nodes to the fewest edits that lead there.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room = [0]  # the most edits of a term below the node
        for term in terms:
            node, bare = 0, term.rstrip("*")
            path = [0]
            for c in bare:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.room.append(0)
                node = self.child[node][c]
                path.append(node)
            (self.stem if term.endswith("*") else self.word)[node] = term
            for p in path:
                self.room[p] = max(self.room[p], edits_of(term))
        self.states: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.dead = self.state({})
        self.start = self.state(self.close({0: 0}))

    def close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds what leaving out letters of a term reaches."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if nodes.get(node) != edits:
                continue
            for after in self.child[node].values():
                if edits + 1 <= self.room[after] and nodes.get(after, 99) > edits + 1:
                    nodes[after] = edits + 1
                    todo.append((after, edits + 1))
        return nodes

    def state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            ends = [(e, self.word[n]) for n, e in key if self.word[n] and e <= edits_of(self.word[n])]
            self.ends.append(min(ends)[::-1] if ends else None)
            self.stems.append(next((self.stem[n] for n, e in key if e == 0 and self.stem[n]), None))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            moves = [(to, edits + (letter != c)) for letter, to in self.child[node].items()] + [(node, edits + 1)]
            for to, e in moves:
                if e <= self.room[to] and after.get(to, 99) > e:
                    after[to] = e
        self.steps[state][c] = out = self.state(self.close(after))
        return out

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or of a stem the word begins with."""
        state, stem = self.start, None
        for c in word:
            steps = self.steps[state]
            state = steps[c] if c in steps else self.step(state, c)
            if state == self.dead:
                return (stem, 0) if stem else None
            stem = self.stems[state] or stem
        return self.ends[state] or ((stem, 0) if stem else None)


def bare(chunk: str) -> str:
    return chunk.lower().strip(EDGE)


@dataclass
class Lexicon:
    weights: dict[str, float]
    innocent: frozenset[str] = frozenset()  # misspellings that clean documents use as words
    automaton: Automaton = field(init=False, repr=False, default=None)

    def __getstate__(self):
        return {"weights": self.weights, "innocent": self.innocent}

    def __setstate__(self, state):
        self.__init__(**state)

    def match(self, word: str) -> tuple[str, int] | None:
        if self.automaton is None:
            self.automaton = Automaton(sorted(self.weights))
        found = self.automaton.find(word)
        if found and word not in self.innocent:
            return found
        return None

    def features(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        """Per text: weight of exact, misspelt, aimed and quoted hits, hits per word, different terms."""
        out = np.zeros((len(texts), FEATURES))
        for row, text in enumerate(texts):
            chunks = text.split() if text else []
            hits = np.flatnonzero(np.frombuffer(bytes(map(memo.__getitem__, chunks)), np.uint8))
            if not len(hits):
                continue
            terms = set()
            sums = [0.0, 0.0, 0.0, 0.0]
            quoted_lines = ">" in text
            for i in hits.tolist():
                term, edits = self.match(bare(chunks[i]))
                terms.add(term)
                around = chunks[max(0, i - WINDOW) : i] + chunks[i + 1 : i + 1 + WINDOW]
                names = {bare(c) for c in around}
                before = sum(c in QUOTES for w in chunks[max(0, i - WINDOW) : i] for c in w) + (chunks[i][0] in QUOTES)
                after = sum(c in QUOTES for w in chunks[i + 1 : i + 1 + WINDOW] for c in w) + (chunks[i][-1] in QUOTES)
                in_line = quoted_lines and any(c.startswith(">") for c in chunks[max(0, i - WINDOW) : i + 1])
                weight = self.weights[term]
                if (before % 2 and after % 2) or in_line or names & REPORTING:
                    sums[3] += weight
                else:
                    sums[1 if edits else 0] += weight
                    if names & ADDRESS:
                        sums[2] += weight
            out[row] = [*map(math.log1p, sums), 10 * min(1.0, 10 * len(hits) / len(chunks)), math.log1p(len(terms))]
        return out

    def memo(self) -> Memo:
        return Memo(lambda chunk: 1 if self.match(bare(chunk)) else 0)


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float

    def scores(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.lexicon.features(texts, memo) @ np.array(self.weights) + self.bias)))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): how many toxic and clean documents hold each word and stem."""

    def run(batches):
        for batch in slices(batches):
            terms, flags = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {bare(c) for c in text.split()} - {""}
                found = words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}
                terms += found
                flags += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(flags, pa.int64())], names=["term", "toxic"])

    return rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "term string, toxic long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def lexicon_of(rows: DataFrame, most_terms: int = 2000, least_documents: int = 3, least_odds: float = 2.5) -> Lexicon:
    """Terms far more frequent in toxic than in clean documents, the strongest first."""
    n = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).head()
    toxic, clean = n["t"] or 0, n["n"] - (n["t"] or 0)
    counts = settle(term_counts(rows))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    need = max(least_documents, toxic // 200)
    best = counts.where(F.col("toxic") >= need).withColumn("odds", odds).where(F.col("odds") >= least_odds).orderBy(
        F.desc(F.col("odds") * F.log1p("toxic")), "term").limit(most_terms).collect()
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in best if len(r["term"].rstrip("*")) > 2})

    def near(batches):
        for batch in batches:
            keep = [bool((hit := lexicon.match(t)) and hit[1]) for t in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    used = counts.where(~F.col("term").endswith("*") & (F.col("clean") > 0)).select("term").mapInArrow(near, "term string")
    # At most the words of the bounded sample that lie within two edits of a term.
    return Lexicon(lexicon.weights, frozenset(r["term"] for r in used.collect()))


def learnt(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """A model from labelled documents (labels: doc_id, toxic).

    The fit takes about `most_rows` labelled documents, chosen by a hash of the id; equal texts
    count once. Weights are fitted on features from a lexicon that has not seen the document
    (two halves), the final lexicon comes from all.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    labels = settle(labels)
    every = max(1, labels.count())
    picked = labels.where(F.pmod(F.xxhash64("__id", F.lit("toxic")), F.lit(every)) < most_rows)
    # At most about `most_rows` pairs of numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).where("text is not null")
    rows = settle(rows.groupBy(F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select(
        "text", "toxic", (F.pmod("mark", F.lit(2)) == 0).alias("half")))
    lexicon = lexicon_of(rows)
    flat = Model(lexicon, [0.0] * FEATURES, 0.0)
    kinds = rows.select("toxic").distinct().count()
    if not lexicon.weights or kinds < 2:
        share = rows.agg(F.avg("toxic")).head()[0] or 0.0
        flat.bias = math.log((share + 1e-3) / (1 - share + 1e-3))
        return flat
    halves = [lexicon_of(rows.where("half")), lexicon_of(rows.where("not half"))]

    def features(batches):
        memos = [h.memo() for h in halves]
        for batch in slices(batches):
            text, toxic, half = (batch.column(i).to_pylist() for i in range(3))
            values = [halves[bool(h) * 1].features([t], memos[bool(h) * 1])[0].tolist() for t, h in zip(text, half)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), pa.array([float(t) for t in toxic])],
                                             names=["features", "label"])

    table = rows.select("text", "toxic", "half").mapInArrow(features, "features array<double>, label double")
    table = settle(table).withColumn("features", array_to_vector("features"))
    fit = LogisticRegression(regParam=1e-3, maxIter=50).fit(table)
    # Quotation may excuse a hit, never make it worse than a direct one.
    weights = [float(w) for w in fit.coefficients]
    weights[3] = min(weights[3], weights[0] / 2)
    return Model(lexicon, weights, float(fit.intercept))


def score_of(text: Column, model: Model, spark) -> Column:
    """Score from 0 to 1 of a text column; null is the empty text, which has no hits."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        global_memo = MEMOS.get(sent.value)
        found = [sent.value.scores(part.to_pylist(), global_memo) for part in slices([column])]
        return pa.array(np.concatenate([np.empty(0), *found]), pa.float64())

    return score.asNondeterministic()(text)  # else a filter on the score would run it twice


class Memos:
    """The word memory of the model a Python worker used last."""

    def __init__(self):
        self.of, self.memo = None, None

    def get(self, model: Model) -> Memo:
        if self.of is not model:
            self.of, self.memo = model, model.lexicon.memo()
        return self.memo


MEMOS = Memos()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. Repeated rows and null ids are like others; an empty table
    gives no rows; empty texts get the score of a text without hits."""
    return docs.select("doc_id", score_of(F.col("text"), model, docs.sparkSession).alias("score"))
