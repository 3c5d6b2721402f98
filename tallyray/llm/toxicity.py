"""Toxicity scores from a learned lexicon, matched with spelling errors.

Fitting, on at most ``max_rows`` labelled rows (a seeded sample; held-out rows
are never read):

1. the lexicon: words that occur in toxic texts far more often than in others
   (likelihood ratio over document counts, counted by Spark), each with its
   log odds as weight; at most ``MAX_TERMS``;
2. a logistic regression over a handful of figures per text.

Scoring a text: the lexicon is a trie, and each distinct word of the text is a
Levenshtein automaton (all strings within one edit); running the automaton
down the trie gives the terms the word may stand for.  Two words with a digit
or masking sign between them are also tried as one (``id1ot``), unless one of
them is a term itself.  Every hit, misspelled ones at half their weight, is
then seen in its context window: a hit in quotation marks or after a word of
reporting is a quotation, any other counts as abuse, and hits close together
add up.

Labels, language, source and id of a document are never inputs of its score.

Defined results: null and empty texts score as texts without hits; without
labelled rows of both classes every text scores the share of toxic rows;
repeated label rows count as often as they occur, null labels not at all.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Words
from .common import small_batches, stored, whole_text
from .linear import Logistic, at_most, fit_logistic, held_out

MAX_TERMS = 8192
MIN_DOCS = 4
MIN_RATIO = 16.0
MIN_TERM = 4
# Terms shorter than this are only matched as they are spelt.
FUZZY_FROM = 5
SPAN = 40
THRESHOLD = 0.3
# The share of its weight that a misspelled hit has.
FUZZY = 0.5

TOKEN = re.compile(r"[^\W\d_]+")
# A digit or sign between two letters, as in id1ot.
MASK = re.compile(r"[\d_*@$#!+.\-](?<=[^\W\d_].)(?=[^\W\d_])")
QUOTES = "\"“”„«»‹›"
# Words that introduce what somebody else said.
REPORTING = {"said", "says", "called", "calls", "wrote", "quoted", "quote", "replied", "term", "word", "slur",
             "sagte", "schrieb", "nannte", "dijo", "llamó", "escribió", "dit", "écrit", "appelé"}


class Trie:
    """A lexicon as nested dictionaries; the empty key holds the term that ends there."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        for term in weights:
            if len(term) >= FUZZY_FROM:
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = term
                half = 2 if len(term) < 6 else 3
                self.heads.add(term[:half])
                self.tails.add(term[-half:])

    def near(self, word: str) -> tuple[str, int] | None:
        """The heaviest term at the least distance of at most one edit."""
        if word in self.weights:
            return word, 0
        # One edit leaves the first or the last half of a term as it is.
        if len(word) < FUZZY_FROM - 1 or not (word[:2] in self.heads or word[:3] in self.heads
                                              or word[-2:] in self.tails or word[-3:] in self.tails):
            return None
        found = self._one_edit(word)
        return (max(found, key=lambda t: (self.weights[t], t)), 1) if found else None

    def _one_edit(self, word: str) -> set[str]:
        """The automaton of all strings within one edit of ``word``, run down the trie.

        Its states are (letters read, edits made).  Before the edit there is
        one path, the word itself; at each node of it the automaton may skip a
        letter of the word, take a letter of the trie in addition, or take one
        in place of another, and then only reads on exactly.
        """
        found: set[str] = set()
        node, n = self.root, len(word)
        for i in range(n + 1):
            if i < n:
                self._read(node, word, i + 1, found)
            here, after = word[i: i + 1], word[i + 1: i + 2]
            for c, child in node.items():
                if c:
                    if here in child:
                        self._read(child, word, i, found)
                    if here and after in child:
                        self._read(child, word, i + 1, found)
            node = node.get(here) if here else None
            if node is None:
                break
        return found

    @staticmethod
    def _read(node: dict, word: str, i: int, found: set[str]) -> None:
        for c in word[i:]:
            node = node.get(c)
            if node is None:
                return
        if "" in node:
            found.add(node[""])


class Hit(NamedTuple):
    at: int
    weight: float
    fuzzy: bool
    quoted: bool
    term: str


FIGURES = ["abuse", "quoted", "fuzzy", "window", "density", "terms", "strongest"]


class Scorer:
    """A fitted model; compiled lazily on each Python worker."""

    def __init__(self, weights: dict[str, float], model: Logistic | None) -> None:
        self.trie, self.model = Trie(weights), model
        self.near = Words(self.trie.near)

    def hits(self, text: str) -> tuple[list[Hit], int]:
        low = text.lower()
        tokens = TOKEN.findall(low)
        near = {w: m for w in set(tokens) if (m := self.near[w])}
        masked = self._masked(low)
        if not near and not masked:
            return [], len(tokens)
        found, recent, past = [], [], 0
        for at, m in enumerate(TOKEN.finditer(low)):
            w, end = m.group(), m.end()
            recent = [*recent[-3:], w]
            if m.start() < past:  # the second half of a masked word
                continue
            hit = near.get(w)
            if m.start() in masked and not (hit and hit[1] == 0):
                end, hit = masked[m.start()]
                past = end
            if hit:
                term, edits = hit
                before, after = low[max(0, m.start() - SPAN): m.start()], low[end: end + SPAN]
                marked = sum(map(before.count, QUOTES)) % 2 == 1 and any(q in after for q in QUOTES)
                found.append(Hit(at, self.trie.weights[term], edits > 0, marked or any(r in REPORTING for r in recent[:-1]), term))
        return found, len(tokens)

    def _masked(self, low: str) -> dict[int, tuple[int, tuple[str, int]]]:
        """By the start of a word that goes on after a masking sign: its end, and the term it stands for."""
        found = {}
        for m in MASK.finditer(low):
            start, end = m.start(), TOKEN.match(low, m.end()).end()
            while start and low[start - 1].isalnum() and not low[start - 1].isdecimal():
                start -= 1
            if low[m.end(): end] not in self.trie.weights and (hit := self.near[low[start: end]]):
                found[start] = end, hit
        return found

    def figures(self, text: str) -> list[float]:
        hits, n = self.hits(text)
        if not hits:
            return [0.0] * len(FIGURES)
        hits = [h._replace(weight=h.weight * FUZZY) if h.fuzzy else h for h in hits]
        window, start, total = 0.0, 0, 0.0
        for h in hits:  # the heaviest run of hits within SPAN words; quotations weigh a quarter
            total += h.weight / (4 if h.quoted else 1)
            while h.at - hits[start].at > SPAN:
                total -= hits[start].weight / (4 if hits[start].quoted else 1)
                start += 1
            window = max(window, total)
        return [math.log1p(sum(h.weight for h in hits if not h.quoted)), math.log1p(sum(h.weight for h in hits if h.quoted)),
                math.log1p(sum(h.weight for h in hits if h.fuzzy and not h.quoted)), math.log1p(window),
                math.log1p(100 * sum(FUZZY if h.fuzzy else 1 for h in hits) / n), math.log1p(len({h.term for h in hits})),
                max((h.weight for h in hits if not h.quoted), default=0.0)]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.figures(t) for t in texts], float).reshape(-1, len(FIGURES))
        return self.model.score(x)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    logistic: Logistic


_scorers: dict[int, Scorer] = {}


def _scorer(key: int, weights: dict[str, float], logistic: Logistic | None) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(weights, logistic)
    return _scorers[key]


def lexicon(train: DataFrame) -> dict[str, float]:
    """Terms and weights from (text, toxic); the counting is done by Spark, the result has at most MAX_TERMS rows."""
    n = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not 0 < n.t < n.n:
        return {}
    share = n.t / n.n
    terms = (train.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(
                F.lower("text"), F.lit(rf"[\p{{L}}]{{{MIN_TERM},40}}"), F.lit(0)))).alias("term"))
             .groupBy("term").agg(F.sum("toxic").alias("tox"), F.count("*").alias("n"))
             .where((F.col("tox") >= MIN_DOCS) & (F.col("tox") > 3 * share * F.col("n"))))
    clean = F.col("n") - F.col("tox")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("tox"), share) + part(clean, 1 - share))
    odds = F.log((F.col("tox") + 0.5) / (n.t + 1.0)) - F.log((clean + 0.5) / (n.n - n.t + 1.0))
    top = (terms.select("term", odds.alias("odds"), ratio.alias("ratio")).where(F.col("ratio") >= MIN_RATIO)
           .orderBy(F.desc("ratio"), "term").limit(MAX_TERMS))
    return {r.term: float(r.odds) for r in top.collect() if r.odds > 0}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 17) -> Model:
    """Fit on at most about ``max_rows`` labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    known = at_most(known, max_rows, F.col("doc_id"), seed)
    train = stored(docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(known, "doc_id").select("text", "toxic"))
    weights = lexicon(train)
    shared = spark.sparkContext.broadcast(weights)
    key = hash(tuple(sorted(weights.items())))

    @F.arrow_udf("array<double>")
    def figures(texts: pa.Array) -> pa.Array:
        scorer = _scorer(key, shared.value, None)
        return pa.array([scorer.figures(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    rows = train.select(figures("text").alias("x"), "toxic").toPandas()  # at most max_rows short rows
    x = np.array(rows.x.tolist(), float).reshape(-1, len(FIGURES))
    return Model(weights, fit_logistic(x, rows.toxic.to_numpy(float)))


def score(spark: SparkSession, model: Model, text: Column | str) -> Column:
    """The toxicity of a text, 0 to 1."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.logistic))
    key = hash((tuple(sorted(model.weights.items())), model.logistic.bias))

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        scorer = _scorer(key, *shared.value)
        return pa.array(scorer.scores([t.as_py() or "" for t in texts]), pa.float64())

    return toxicity(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        score(docs.sparkSession, model, "text").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
