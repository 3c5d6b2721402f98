"""The best documents for each item of a query set, by exact lexical scores.

Method: buckets by norm (LEMP).  A document is the vector of its terms' impacts, an item the vector of its terms'
weights, a score their inner product.  Impact vectors are ordered by length and cut into buckets.  The bucket of the
longest vectors is searched first: the tenth score found there bounds each item's final tenth score from below.  By
Cauchy-Schwarz a bucket whose longest vector times the item's length stays under that bound is pruned; inside a
bucket, the item's heaviest terms (its focus) are summed exactly, the rest is bounded by the length of what is left
of both vectors, and documents whose bound is too low are filtered.  Survivors are scored exactly in 64-bit integers.

Scale: the query set is taken in blocks of about ``BLOCK_BYTES`` of text; a block's vocabulary, weights and scores of
tenth places are what is broadcast.  For each block the documents are read once into impact vectors over the block's
vocabulary, dealt by range of length (ties by a hash, so that many equal documents spread).  Every task keeps ten
documents an item, and only those that reach the bound leave it.

Defined results: a null or empty text has no terms: as a document it counts nowhere, as an item it has no rows.  Rows
that repeat a doc_id or an item_id are documents and items of their own.  A null doc_id ranks after all others of
equal score.  An empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

TOP = 10
FOCUS = 8
BUCKET = 4096
BLOCK_BYTES = 8 << 20
SLACK = 1 + 1e-9

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: the contract's terms byte by byte


def terms(text: str | None) -> list[bytes]:
    """The terms of a text; ``bytes.lower`` changes A-Z only."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms), cols (places in the broadcast vocabulary) and tfs of every document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1)):
                found = terms(t.as_py())
                if found:
                    tf = Counter(found)
                    at = sorted((known[w], tf[w]) for w in tf.keys() & known.keys())
                    rows.append((i, len(found), [a for a, _ in at], [f for _, f in at]))
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["doc_id", "n", "cols", "tfs"])

    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")) \
        .mapInArrow(count, "doc_id long, n long, cols array<int>, tfs array<int>")


def impacts(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, cols and imps of the documents of ``counted`` that hold a term of the vocabulary."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs = batch.column(3)
            lengths = pa.compute.list_value_length(tfs).to_numpy(zero_copy_only=False)
            tf = tfs.flatten().to_numpy().astype(np.int64)
            m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)  # Python integers: no overflow
            imp = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, lengths))
            row = np.repeat(np.arange(len(m)), lengths)
            norm = np.sqrt(np.bincount(row, imp.astype(float) ** 2, len(m)))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(imp.astype(np.int32)))],
                ["doc_id", "norm", "cols", "imps"])

    return index.where(F.size("cols") > 0).mapInArrow(weigh, "doc_id long, norm double, cols array<int>, imps array<int>")


class Query:
    """The terms of an item that some document holds, heaviest first, and the length of what follows the focus."""

    def __init__(self, cols: np.ndarray, weights: np.ndarray):
        order = np.lexsort((cols, -weights))
        self.cols, self.weights = cols[order], weights[order]
        squares = self.weights.astype(float) ** 2
        self.norm = math.sqrt(squares.sum())
        self.rest = math.sqrt(squares[FOCUS:].sum())


class Best:
    """The best ``TOP`` documents so far: higher scores first, then smaller ids, null last."""

    def __init__(self, bound: int):
        self.score, self.null, self.id, self.bound = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), bound

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = np.concatenate([self.score, score]), np.concatenate([self.null, null]), np.concatenate([self.id, doc])
        order = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.null, self.id = score[order], null[order], doc[order]
        if len(order) == TOP:
            self.bound = max(self.bound, int(self.score[-1]))


def search_bucket(queries: list[Query], best: list[Best], norm: np.ndarray, lengths: np.ndarray, cols: np.ndarray, imps: np.ndarray,
                  null: np.ndarray, doc: np.ndarray, width: int) -> None:
    """One bucket of documents against all items that its longest vector can still serve."""
    longest = float(norm.max()) * SLACK
    active = [i for i, q in enumerate(queries) if q.norm * longest >= best[i].bound]
    if not active:
        return
    order = np.argsort(cols, kind="stable")
    row, imp = np.repeat(np.arange(len(norm)), lengths)[order], imps[order].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=width))])
    squares, length2 = imp.astype(float) ** 2, norm ** 2
    for i in active:
        q, b = queries[i], best[i]
        total, used = np.zeros(len(norm), np.int64), np.zeros(len(norm))
        for c, w in zip(q.cols[:FOCUS], q.weights[:FOCUS]):
            at = slice(starts[c], starts[c + 1])
            total[row[at]] += w * imp[at]
            used[row[at]] += squares[at]
        bound = (total + q.rest * np.sqrt(np.maximum(length2 * SLACK - used, 0))) * SLACK
        left = np.flatnonzero(bound >= max(b.bound, 1))
        if not len(left):
            continue
        for c, w in zip(q.cols[FOCUS:], q.weights[FOCUS:]):
            at = slice(starts[c], starts[c + 1])
            total[row[at]] += w * imp[at]
        left = left[total[left] >= max(b.bound, 1)]
        if len(left):
            b.add(total[left], null[left], doc[left])


def searched(index: DataFrame, queries, bounds: list[int], width: int) -> DataFrame:
    """(item, doc_id, score): of every task the best of each item; ``queries`` is a broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = queries.value
        best = [Best(b) for b in bounds]
        held: list[pa.RecordBatch] = []

        def run() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["doc_id"]
            lists = t["cols"].combine_chunks()
            search_bucket(items, best, t["norm"].to_numpy(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False),
                          lists.flatten().to_numpy(), t["imps"].combine_chunks().flatten().to_numpy(),
                          ids.is_null().to_numpy(), ids.fill_null(0).to_numpy(), width)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUCKET:
                run()
        if held and any(b.num_rows for b in held):
            run()
        sizes = [len(b.id) for b in best]
        if sum(sizes):
            nulls = np.concatenate([b.null for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32)), pa.array(np.concatenate([b.id for b in best]), mask=nulls),
                 pa.array(np.concatenate([b.score for b in best]))], ["item", "doc_id", "score"])

    return index.select("doc_id", "norm", "cols", "imps").mapInArrow(search, "item int, doc_id long, score long")


def first_places(found: DataFrame) -> DataFrame:
    """The ``TOP`` rows of each item with their rank."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= TOP)


def search_block(docs: DataFrame, items: list) -> DataFrame:
    """item_id, rank, doc_id, score for one block of items (rows of item_id and text)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    held = [sorted(set(terms(r["text"]))) for r in items]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*held)))}
    counts = stored(counted(docs, context.broadcast(vocabulary)))
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    # One row for each term of the block's vocabulary at most.
    df = {r["col"]: r["df"] for r in counts.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count("*").alias("df")).collect()}
    weight = {c: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for c, d in df.items()}
    queries = []
    for own in held:
        cols = np.array([vocabulary[w] for w in own if vocabulary[w] in weight], np.int64)
        queries.append(Query(cols, np.array([weight[c] for c in cols], np.int64)))
    sent = context.broadcast(queries)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_length = [F.desc("norm"), F.xxhash64("doc_id", "cols")]
    index = stored(impacts(counts, n_docs, n_terms).repartitionByRange(parts, *by_length).sortWithinPartitions(F.desc("norm"))
                   .withColumn("bucket", F.spark_partition_id()))
    # Longest vector of each bucket: one row per partition.
    lengths = {r["bucket"]: r["longest"] for r in index.groupBy("bucket").agg(F.max("norm").alias("longest")).collect()}
    first = min(lengths, default=0)
    head = stored(searched(index.where(F.col("bucket") == first), sent, [0] * len(items), len(vocabulary)))
    bounds = [0] * len(items)
    for r in first_places(head).where(F.col("rank") == TOP).select("item", "score").collect():
        bounds[r["item"]] = r["score"]
    alive = [k for k, longest in lengths.items() if k != first and any(q.norm * longest * SLACK >= b for q, b in zip(queries, bounds))]
    last = max(alive, default=first)  # lengths fall from bucket to bucket: one range holds all that are left
    rest = searched(index.where((F.col("bucket") > first) & (F.col("bucket") <= last)), sent, bounds, len(vocabulary))
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")
    return first_places(head.unionByName(rest)).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each item."""
    small_batches(docs.sparkSession)
    items = stored(benchmark.select(F.col("`item_id`").cast("long").alias("item_id"), F.col("`text`").alias("text"))
                   .withColumn("n", F.monotonically_increasing_id()))
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).select("item_id", "text").collect()  # about BLOCK_BYTES
        if part:
            rows = stored(search_block(docs, part))
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
