"""Exact top-k search by inner product, pruned with segment statistics.

Vectors are quantised to integers, floor(1024 x).  Of every vector the means
and deviations of its segments are kept at several resolutions.  For a segment
of length n the squared distance of two vectors is at least
n (difference of means)^2 + n (difference of deviations)^2; with the norms
known, a lower bound on the distance is an upper bound on the inner product,
sum of n (mean * mean + deviation * deviation).  Candidates are filtered with
it from coarse to fine against the query's k-th best score so far, and the
survivors get their exact integer score.

Queries meet all rows in blocks: rows are dealt by a hash of their number into
blocks of about ``BLOCK_ROWS``, queries into blocks of about ``BLOCK_QUERIES``,
and each pair of blocks is one group of a cogroup, so that what a task holds is
bounded and nothing is broadcast.  The best k of a query in each block are
ranked together at the end.

Defined results: vectors that are null, empty, or hold null or non-finite
components, and rows without id, take no part; vectors of different lengths
have no score with each other; rows that repeat an id are candidates of their
own, and no candidates of a query with that id; of queries with one id the best
k of all their scores are returned; ties go to the smaller id; a query with
fewer than k candidates gets all of them; scores beyond a long are cut to its
range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
K = 10
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2_048
SUB_ROWS = 4_096
SEGMENTS = (1, 4, 16)
LONG = np.iinfo(np.int64)


def quantised(embedding: Column | str) -> Column:
    """floor(1024 x) of each component as array<double>, or null if the vector takes no part."""
    vec = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(embedding) > 0) & whole, vec)


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments, weighted so that a product of two rows is their bound."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        seg = x[:, a:b]
        out += [seg.mean(1) * np.sqrt(b - a), seg.std(1) * np.sqrt(b - a)]
    return np.column_stack(out)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles hold them exactly below 2^53; beyond, Python's integers do."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    big = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, big)), LONG.min), LONG.max) for row in x], np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of the block: (query id, ids, scores)."""
    levels = [(statistics(x, p), statistics(q, p)) for p in SEGMENTS]
    # Bounds are doubles: this much over them is certainly above any exact score.
    slack = 1.0 + 1e-9 * np.sqrt((x**2).sum(1).max(initial=0.0)) * np.sqrt((q**2).sum(1))
    for i, own in enumerate(query_ids):
        top_ids, top = np.empty(0, np.int64), np.empty(0, np.int64)
        for a in range(0, len(ids), SUB_ROWS):
            at = np.flatnonzero(ids[a: a + SUB_ROWS] != own) + a
            if len(top) >= k:
                for rows, queries in levels:
                    at = at[rows[at] @ queries[i] + slack[i] >= top[-1]]
            if len(at):
                all_ids, all_scores = np.concatenate([top_ids, ids[at]]), np.concatenate([top, exact(x[at], q[i])])
                order = best(all_scores, all_ids, k)
                top_ids, top = all_ids[order], all_scores[order]
        yield int(own), top_ids, top


def _search(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        found = search_block(rows.vec_id.to_numpy(np.int64), np.stack(rows.vec), queries.vec_id.to_numpy(np.int64), np.stack(queries.vec))
        for own, ids, scores in found:
            out["query_id"] += [own] * len(ids)
            out["vec_id"] += ids.tolist()
            out["score"] += scores.tolist()
    return pd.DataFrame(out).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for every row of (vec_id, embedding) that ``is_query`` marks."""
    rows = (vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("vec"))
            .where("vec is not null").withColumn("dim", F.size("vec")).withColumn("query", is_query)
            .withColumn("n", F.monotonically_increasing_id()))
    rows = stored(rows)  # written once: later reads see the same numbers
    n = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("query").cast("int")), F.lit(0)).alias("queries")).first()
    row_blocks, query_blocks = -(-n.rows // block_rows) or 1, -(-n.queries // block_queries) or 1
    deal = lambda blocks: F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = (rows.where("query").select("vec_id", "vec", "dim", deal(query_blocks).alias("qb"), every(row_blocks).alias("rb")))
    right = rows.select("vec_id", "vec", "dim", deal(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    keys = ["dim", "rb", "qb"]

    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInPandas(_search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
