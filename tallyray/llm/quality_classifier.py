"""Quality scores by co-training two views of a document.

The *text view* sees figures of the text alone; the *metadata view* sees only
what a crawl knows about a page without reading it: source, language, length.
Each view has a logistic regression.  In every round both classifiers score a
pool of unlabelled documents, and the rows that one is confident about are
given, with its label, to the other (with less weight than true labels).  At
the end each view is calibrated on labelled rows kept back from its fit (Platt
scaling), a last logistic regression over the two calibrated logits combines
them, and all documents are scored.

Fitting reads at most ``max_rows`` labelled rows and ``max_pool`` unlabelled
rows (seeded samples); rows held out are never read for it.  Scoring covers
every document whole.

Defined results: null and empty texts have the figures of an empty text; a
null source or language is a value of its own, a null length is that of the
empty text; without labelled rows of both classes every document scores the
share of good rows; repeated and null labels as in ``toxicity``.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .linear import Logistic, at_most, fit_logistic, held_out, sigmoid

ROUNDS = 4
CONFIDENT = 0.97
PSEUDO_WEIGHT = 0.3
PER_ROUND = 1000
THRESHOLD = 0.5

SOURCE_BINS, LANG_BINS = 64, 16
_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_MARKED = re.compile(rb"[^\w\s\x80-\xff]{2,}(?=\s|$)")


def text_figures(text: str) -> list[float]:
    """The text view."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    lines = [s for s in data.split(b"\n") if s.strip()]
    rows = max(1, len(lines))
    upper = sum(map(bytes.isupper, words))
    return [
        math.log1p(len(words)), min(len(data) / n, 30.0),
        math.log1p(10 * len(data.translate(None, _SYMBOLS)) / n),
        upper / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n * math.log1p(n),
        math.log1p(10 * len(_MARKED.findall(data)) / n),
        sum(s.rstrip()[-1:] in b".!?\"" for s in lines) / rows,
        sum(map(bytes.isdigit, words)) / n,
        math.log1p(data.count(b"!") / n * 10), math.log1p(rows), 1.0 - len(set(lines)) / rows,
    ]


TEXT_SIZE = 12


def meta_figures(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """The metadata view: hashed source and language, and the length."""
    out = [0.0] * (SOURCE_BINS + LANG_BINS + 2)
    out[zlib.crc32(("s:" + source if source is not None else "null").encode()) % SOURCE_BINS] = 1.0
    out[SOURCE_BINS + zlib.crc32(("l:" + lang if lang is not None else "null").encode()) % LANG_BINS] = 1.0
    size = math.log1p(max(0, n_chars or 0))
    out[-2:] = size, size * size / 10
    return out


@dataclass(frozen=True)
class View:
    """A classifier and its calibration: calibrated logit = a * logit + b."""

    model: Logistic
    a: float
    b: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.model.logit(x) + self.b


@dataclass(frozen=True)
class Model:
    text: View
    meta: View
    combined: Logistic

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logit(xt), self.meta.logit(xm)
        return sigmoid(t), sigmoid(m), self.combined.score(np.column_stack([t, m]))


def confident(scores: np.ndarray, limit: int) -> np.ndarray:
    """Rows that a classifier is sure of, the surest of each class first, at most ``limit`` of a class."""
    order = np.argsort(scores, kind="stable")
    low = order[: int((scores <= 1 - CONFIDENT).sum())][:limit]
    high = order[::-1][: int((scores >= CONFIDENT).sum())][:limit]
    return np.concatenate([low, high])


def calibrated(model: Logistic, x: np.ndarray, y: np.ndarray) -> View:
    fitted = fit_logistic(model.logit(x)[:, None], y)
    a = float(fitted.weight[0] / fitted.scale[0])
    return View(model, a, fitted.bias - a * float(fitted.mean[0]))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pt: np.ndarray, pm: np.ndarray) -> Model:
    """xt, xm, y: both views of the labelled rows; pt, pm: both views of the pool."""
    check = np.arange(len(y)) % 4 == 0  # rows come in a seeded order
    own_t, own_m, own_y = xt[~check], xm[~check], y[~check]
    sure = {"text": {}, "meta": {}}  # pool rows and labels each view was given

    def fitted(x: np.ndarray, pool: np.ndarray, given: dict[int, float]) -> Logistic:
        at = np.fromiter(given, int, len(given))
        return fit_logistic(np.vstack([x, pool[at]]), np.concatenate([own_y, np.fromiter(given.values(), float, len(given))]),
                            np.concatenate([np.ones(len(x)), np.full(len(at), PSEUDO_WEIGHT)]))

    text, meta = fitted(own_t, pt, {}), fitted(own_m, pm, {})
    for _ in range(ROUNDS):
        by_text, by_meta = text.score(pt), meta.score(pm)
        sure["meta"] |= {int(i): float(by_text[i] > 0.5) for i in confident(by_text, PER_ROUND)}
        sure["text"] |= {int(i): float(by_meta[i] > 0.5) for i in confident(by_meta, PER_ROUND)}
        text, meta = fitted(own_t, pt, sure["text"]), fitted(own_m, pm, sure["meta"])
    views = calibrated(text, xt[check], y[check]), calibrated(meta, xm[check], y[check])
    both = np.column_stack([views[0].logit(xt[check]), views[1].logit(xm[check])])
    return Model(*views, fit_logistic(both, y[check]))


def view_columns(text: Column | str, source: Column | str, lang: Column | str, n_chars: Column | str) -> Column:
    """Both views of a document as an array: the text's figures, then the metadata's."""

    @F.arrow_udf("array<double>")
    def views(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([text_figures(t.as_py() or "") + meta_figures(s.as_py(), g.as_py(), n.as_py())
                         for t, s, g, n in zip(texts, sources, langs, sizes)], pa.list_(pa.float64()))

    return views(text, source, lang, n_chars)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_pool: int = 20_000, seed: int = 29) -> Model:
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col("quality").cast("double").alias("y"))
    known = at_most(known, max_rows, F.col("doc_id"), seed)
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("double").alias("y"))
    free = at_most(free, max_pool, F.col("doc_id"), seed)
    chosen = stored(known.union(free))
    cols = [whole_text(F.col("text")), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    rows = (docs.join(chosen, "doc_id").select("doc_id", "y", view_columns(*cols).alias("x"))
            .toPandas())  # at most max_rows + max_pool rows of numbers
    rows = rows.assign(order=[zlib.crc32(f"{seed}:{i}".encode()) for i in rows.doc_id]).sort_values(["order", "doc_id", "y"])
    x = np.array(rows.x.tolist(), float).reshape(len(rows), -1 if len(rows) else TEXT_SIZE + SOURCE_BINS + LANG_BINS + 2)
    y = rows.y.to_numpy(float)
    has = ~np.isnan(y)
    xt, xm = x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]
    return co_train(xt[has], xm[has], y[has], xt[~has], xm[~has])


def score(spark: SparkSession, model: Model, text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """struct<text_score, meta_score, score> of a document."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<text_score:double,meta_score:double,score:double>")
    def quality(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        xt = np.array([text_figures(t.as_py() or "") for t in texts], float).reshape(-1, TEXT_SIZE)
        xm = np.array([meta_figures(s.as_py(), g.as_py(), n.as_py()) for s, g, n in zip(sources, langs, sizes)],
                      float).reshape(-1, SOURCE_BINS + LANG_BINS + 2)
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in shared.value.scores(xt, xm)],
                                          ["text_score", "meta_score", "score"])

    return quality(text, source, lang, n_chars)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, the scores of both views, the combined score, and whether the document is kept."""
    model = fit(docs, labels)
    s = score(docs.sparkSession, model, F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("s"))
            .select("doc_id", "held_out", "s.*")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .withColumn("kept", F.col("score") >= THRESHOLD))
