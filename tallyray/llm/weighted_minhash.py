"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

1. *Shingles*: five consecutive words, named by 64 bits of hash; texts with
   fewer words are one shingle.  The weight of a shingle is its count in the
   text times an idf.  Document counts are taken over the whole corpus in
   2^18 hashed bins (bounded memory whatever the corpus; a collision only adds
   counts).  The idf runs from 1 to 1 + ``IDF_SHARE``: a large group of copies
   raises the counts of its own shingles, and with an unbounded idf the few
   words its members differ in would outweigh all they share.
2. *Samples*: improved consistent weighted sampling draws, for each of 30
   hash functions, the (shingle, level) of least ``ln c - r (t - b + 1)`` with
   ``t = floor(ln w / r + b)``; two texts draw the same with the probability of
   their weighted Jaccard similarity.  Three samples make a band, ten bands a
   signature: a pair of similarity 0.8 shares a band with probability 0.999.
3. *Candidates*: equal texts (equal sequences of words) are one node.  The
   buckets of the bands are dealt into blocks of at most about ``BLOCK`` nodes:
   a larger bucket is cut by its next band, and what is larger still by a hash
   of the node that differs from band to band, so that groups of any size are
   spread over tasks and held together by ten different cuts.  Inside a block
   each node is compared with all others by the samples they share, and its
   best partners of another class become candidates if they share at least
   ``AGREE`` of 30 (a pair of similarity 0.8 does with probability 0.997).
   These blocks only begin the classes: from the second round on (``spans``)
   all nodes of a bucket that are of different classes meet, whatever its size.
4. *Verification*: candidates of a weighted Jaccard similarity of at least 0.8
   are links; classes are the connected components.  Then nodes look for
   partners outside their class again (nodes of the largest class of a bucket
   are only sought), at most two in the first round and eight of the three best
   of each block in a later one.  ``sketch`` bounds the similarity of a pair
   from above; a pair whose bound is under 0.8 needs no test.
   When links become rare (under one in ``RARE`` tests) a last round lists all
   pairs that are left: untested, of different classes, of one bucket, sharing
   ``AGREE`` samples.  After it none is untested; a round without links does not
   end the search.

Defined results: the class of a document is the least doc_id of its class;
null texts are empty texts, and texts without words are equal texts; a class
of rows without doc_id has none (null); repeated rows are equal texts; nodes
are named by their texts, so that one doc_id may stand for several texts, each
in the class of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, stored_narrow, whole_text

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
BLOCK, TILE = 256, 1024
AGREE = 18
PARTNERS, LATER_PARTNERS, PER_BLOCK = 2, 8, 3
RARE = 8
BIN_BITS = 18
SLICE = 1 << 12
FAN_IN = 1 << 10
IDF_SHARE = 0.15
TABLE_BITS = 16
SKETCH_BITS = 9
PIECE = 1 << 20

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


# -- shingles ---------------------------------------------------------------

def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@functools.lru_cache(maxsize=1)
def _byte_keys() -> np.ndarray:
    return np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=_U) | _U(1)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 14)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size + 1, _U(base), _U)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word, from prefix sums over the bytes: no Python object per word."""
    if len(data) > PIECE:  # cut at white space, so that the tables stay small
        cuts = list(_cut(data))
        if len(cuts) > 1:
            return np.concatenate([word_hashes(d) for d in cuts])
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, _U)
    edge = np.diff(np.concatenate([[True], _SPACES[a], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(a) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_byte_keys()[a] * power[: len(a)])])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))


def _cut(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACES[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    width = min(n, WORDS)
    h = np.full(n - width + 1, width, _U)
    for k in range(width):
        h = h * _U(0xFF51AFD7ED558CCD) + words[k: n - width + 1 + k]
    return np.unique(mixed(h), return_counts=True)


def text_names(words: np.ndarray) -> tuple[int, int]:
    """128 bits that name the sequence of words."""
    power, _ = _power_tables(len(words) + 1)
    n = _U(len(words))
    a = mixed(np.array([(words * power[: len(words)]).sum(dtype=_U) + n]))
    b = mixed(np.array([(mixed(words + _U(1)) * power[: len(words)][::-1]).sum(dtype=_U) ^ n]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _bins(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - BIN_BITS)).astype(np.int64)


# -- corpus statistics ------------------------------------------------------

def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's document counts, as slices of the vector of bins."""
    from pyspark import TaskContext

    total = np.zeros(1 << BIN_BITS, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            found = [shingles(word_hashes((t.as_py() or "").encode("utf-8", "surrogatepass")))[0] for t in batch.column(0)[k: k + 256]]
            total += np.bincount(_bins(np.concatenate(found)), minlength=1 << BIN_BITS)
    part = TaskContext.get().partitionId()
    cuts = [total[i: i + SLICE].astype("<i8").tobytes() for i in range(0, len(total), SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()),
                                      pa.array(cuts, pa.binary())], ["part", "slice", "counts"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.int64)
    for c in pdf.counts:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN_IN], "slice": [int(pdf["slice"].iloc[0])], "counts": [total.tobytes()]})


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf by bin, from document counts over the whole corpus: 2^18 numbers, a fixed size.

    Partial vectors are added ``FAN_IN`` at a time, then the sums of these: a million tasks make groups of at most
    1,024 slices of 32 KB.
    """
    schema = "part long, slice int, counts binary"
    parts = docs.select("text").mapInArrow(_count_bins, schema)
    for _ in range(2):
        parts = parts.groupBy("slice", F.expr(f"part div {FAN_IN}")).applyInPandas(_add, schema)
    rows = parts.select("slice", "counts").collect()  # 64 rows for each million tasks
    df = np.zeros(1 << BIN_BITS, np.int64)
    for r in rows:
        df[r["slice"] * SLICE: (r["slice"] + 1) * SLICE] += np.frombuffer(r["counts"], "<i8")
    n = max(1, docs.count())
    return (1.0 + IDF_SHARE * np.log1p(n / np.maximum(df, 1)) / np.log1p(n)).astype(np.float32)


# -- samples ----------------------------------------------------------------

@functools.lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, ...]:
    """Tables of the random variables of the sampling, and the hash functions that look them up."""
    rng = np.random.default_rng(7)
    size = 1 << TABLE_BITS
    r = rng.gamma(2.0, 1.0, size).astype(np.float32)
    return (r, (1 / r).astype(np.float32), rng.random(size).astype(np.float32),
            np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32),
            rng.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=_U) | _U(1))


def signature(names: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of the bands of a weighted set (int64), and 16 bits of each sample; names ascending."""
    r, inv, beta, lnc, odd = _draws()
    lnw = np.log(weight).astype(np.float32)
    best = np.full(len(odd), np.inf, np.float32)
    sample = np.zeros(len(odd), _U)
    rows = np.arange(len(odd))
    for a in range(0, len(names), 1 << 13):
        part = names[a: a + (1 << 13)]
        at = ((part[None, :] * odd) >> _U(64 - TABLE_BITS)).astype(np.int32)
        level = np.floor(lnw[a: a + (1 << 13)] * inv[at] + beta[at])
        score = lnc[at] - r[at] * (level - beta[at] + 1)
        low = score.argmin(1)  # ties: the least name, in every text alike
        found = score[rows, low]
        better = found < best
        best = np.where(better, found, best)
        drawn = mixed(part[low] + level[rows, low].astype(np.int64).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        sample = np.where(better, drawn, sample)
    keys = np.arange(1, BANDS + 1).astype(_U)
    for k in range(ROWS):
        keys = mixed(keys * _U(0x9FB21C651E98DF25) + sample.reshape(BANDS, ROWS)[:, k])
    return keys.view(np.int64), (sample >> _U(48)).astype("<u2").tobytes()


def weighted(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, counts = shingles(word_hashes((text or "").encode("utf-8", "surrogatepass")))
    return names, counts * idf[_bins(names)].astype(np.float64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with ascending names."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def sketch(text: str | None, idf: np.ndarray) -> bytes:
    """The weight of a text, and the weights of its shingles by the first bits of their names, rounded up: a fixed size."""
    names, weight = weighted(text, idf)
    parts = np.bincount((names >> _U(64 - SKETCH_BITS)).astype(np.int64), weight, 1 << SKETCH_BITS)
    step = max(float(parts.max()), 1e-9) / 65535
    return np.array([weight.sum(), step]).tobytes() + np.minimum(np.ceil(parts / step), 65535).astype("<u2").tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """Rows of the weight of a text and of its parts."""
    heads = np.stack([np.frombuffer(v, "<f8", 2) for v in sketches])
    parts = np.stack([np.frombuffer(v, "<u2", offset=16) for v in sketches])
    return np.column_stack([heads[:, 0], parts * heads[:, 1, None]]).astype(np.float32)


def at_most_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound on the weighted Jaccard similarity of texts from rows of their sketches."""
    low = np.minimum(a[:, 1:], b[:, 1:]).sum(1)
    return low / np.maximum(a[:, 0] + b[:, 0] - low, 1e-9)


def signed(docs: DataFrame, idf) -> DataFrame:
    """doc_id, x1, x2 (the text's name), bands and samples (null without words); ``idf`` is a broadcast."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2, bands, samples = [], [], [], []
            for t in batch.column(1):
                words = word_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"))
                names, counts = shingles(words)
                for out, v in zip((x1, x2), text_names(words)):
                    out.append(v)
                for out, v in zip((bands, samples), signature(names, counts * idf.value[_bins(names)]) if len(names) else (None, None)):
                    out.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x1, pa.int64()), pa.array(x2, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(samples, pa.binary())], ["doc_id", "x1", "x2", "bands", "samples"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(sign, "doc_id long, x1 long, x2 long, bands array<long>, samples binary")


def named_texts(docs: DataFrame) -> DataFrame:
    """x1, x2, text: names are cheap beside signatures, so that texts need not be stored with them."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [text_names(word_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*[pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)], batch.column(0)], ["x1", "x2", "text"])

    return docs.select("text").mapInArrow(name, "x1 long, x2 long, text string")


# -- candidates, links, classes ----------------------------------------------

def bucketed(nodes: DataFrame) -> DataFrame:
    """(key, next, id, all): the nodes of each bucket of two or more, with its size."""
    band = lambda i: F.element_at("bands", F.pmod(i, F.lit(BANDS)) + 1)
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.struct(F.xxhash64(i, band(i)).alias("key"), F.xxhash64(i, band(i + 1)).alias("next")))
    rows = nodes.select("id", F.inline(keys))
    whole = rows.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > 1)
    return stored(rows.join(whole, "key"))


def blocks(buckets: DataFrame) -> DataFrame:
    """(key, block, id): the first deal of the buckets into bounded blocks; what these do not bring together, ``spans`` does."""
    small = buckets.where(F.col("all") <= BLOCK).select("key", F.lit(0).cast("long").alias("block"), "id")
    rows = buckets.where(F.col("all") > BLOCK)
    cut = rows.groupBy("key", "next").agg(F.count("*").alias("n")).where("n > 1")
    large = rows.join(cut, ["key", "next"]).select(
        "key", F.xxhash64("next", F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") * 2 / BLOCK)))).alias("block"), "id")
    return small.union(large)


def spans(rows: DataFrame) -> DataFrame:
    """rows (key, id, class, samples, sketch, tested) dealt into blocks in which every two nodes of a bucket that are of
    different classes meet, whatever its size.

    The largest class of a bucket is only sought.  In a bucket over ``TILE`` the m others seek in tiles: a tile is one
    of ceil(m / TILE) parts of the seekers against one of ceil(n / TILE) parts of all n, and every such pair of parts is
    a tile.  Once a large group is one class few seekers are left, and its nodes are dealt once.
    """
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"))
    deal = (sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("top"))
            .select("key", "n", F.col("top.class").alias("top"), (F.col("n") - F.col("top.n")).alias("m")).where("m > 0"))
    parts = lambda c: F.ceil(F.col(c) / TILE)
    part = lambda seed, c: F.pmod(F.xxhash64("id", "key", F.lit(seed)), parts(c))
    tile = lambda block, seek, sought: F.struct(block.cast("long").alias("block"), F.lit(seek).alias("seek"), F.lit(sought).alias("sought"))
    seeks = F.col("class") != F.col("top")
    one = F.array(F.struct(F.lit(0).cast("long").alias("block"), seeks.alias("seek"), F.lit(True).alias("sought")))
    sought = F.transform(F.sequence(F.lit(0).cast("long"), parts("m") - 1), lambda i: tile(i * parts("n") + part(1, "n"), False, True))
    seek = F.transform(F.sequence(F.lit(0).cast("long"), parts("n") - 1), lambda j: tile(part(2, "m") * parts("n") + j, True, False))
    tiles = F.when(F.col("n") <= TILE, one).when(seeks, F.concat(sought, seek)).otherwise(sought)
    return (rows.join(deal, "key").select("key", "id", "class", "samples", "sketch", "tested", F.inline(tiles))
            .withColumn("tested", F.when(F.col("seek"), F.col("tested"))))


def _partners(key: np.ndarray, ids: np.ndarray, group: np.ndarray, samples: np.ndarray, tested: pa.Array, most: int | None,
              seek: np.ndarray | None = None, sought: np.ndarray | None = None, sketches: np.ndarray | None = None) -> list[np.ndarray]:
    """Within each run of equal keys, every node that seeks, its ``most`` best (or all) untested partners of other
    groups among the sought, and the samples they share.  Without ``seek`` all but the largest group of a run seek.

    With sketches, pairs whose bound is under ``SIMILARITY`` are none, and partners rank by the bound (in 30,000ths)."""
    past, lengths = tested.flatten().to_numpy(), pc.fill_null(pc.list_value_length(tested), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(lengths)])
    found = []
    edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
    for start, end in zip(edges, edges[1:]):
        if end - start < 2 or (group[start:end] == group[start]).all():
            continue
        if seek is None:
            _, at, counts = np.unique(group[start:end], return_inverse=True, return_counts=True)
            seekers = np.flatnonzero(at != counts.argmax()) if counts.max() > 1 else np.arange(end - start)
        else:
            seekers = np.flatnonzero(seek[start:end])
        y = start + (np.arange(end - start) if sought is None else np.flatnonzero(sought[start:end]))
        if not len(y):
            continue
        theirs, their_ids = np.ascontiguousarray(samples[y].T), ids[y]
        by_id = np.argsort(their_ids)
        for lo in range(0, len(seekers), BLOCK):  # all of the run is compared, some rows of the table at a time
            x = start + seekers[lo: lo + BLOCK]
            shared, least = np.zeros((len(x), len(y)), np.int16), AGREE
            for k in range(len(theirs)):
                shared += samples[x, k, None] == theirs[None, k]
            shared[group[x, None] == group[None, y]] = 0
            if lengths[x].any():
                gone = np.concatenate([past[ends[i]: ends[i + 1]] for i in x])
                place = by_id[np.minimum(np.searchsorted(their_ids, gone, sorter=by_id), len(y) - 1)]
                here = their_ids[place] == gone
                shared[np.repeat(np.arange(len(x)), lengths[x])[here], place[here]] = 0
            if sketches is not None:
                i, j = np.nonzero(shared >= AGREE)
                shared[:], least = 0, 1
                for k in range(0, len(i), SLICE):
                    u, v = i[k: k + SLICE], j[k: k + SLICE]
                    bound = at_most_similar(sketches[x[u]], sketches[y[v]])
                    shared[u, v] = np.where(bound >= SIMILARITY - 1e-4, np.minimum(bound, 1) * 30_000, 0)
            if most is None or most >= len(y):
                i, j = np.nonzero(shared >= least)
            else:
                order = np.argsort(-shared, 1, kind="stable")[:, :most]
                i, j = np.nonzero(np.take_along_axis(shared, order, 1) >= least)
                j = order[i, j]
            found.append(np.column_stack([ids[x[i]], their_ids[j], shared[i, j]]))
    return found


def candidates(rows: DataFrame, turns: int | None, most: int | None) -> DataFrame:
    """(a, b) from rows (key, block, id, class, samples, tested, seek, sought): of every node the best ``turns`` outside
    its class that were not tested before, from the best ``most`` of each of its blocks; without numbers all of them."""
    columns = ["key", "block", "id", "class", "samples", "tested", "seek", "sought"] + ["sketch"] * ("sketch" in rows.columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the run that may go on in the next batch
        for batch in _with_end(batches):
            rest = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if rest is None or not rest.num_rows:
                continue
            key = np.column_stack([rest[c].to_numpy() for c in ("key", "block")])
            cut = rest.num_rows if batch is None else int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key != key[-1]).any() else 0
            left = rest.slice(cut)
            if cut:
                samples = np.stack([np.frombuffer(v.as_py(), "<u2") for v in rest["samples"].slice(0, cut)])
                found = _partners(key[:cut], rest["id"].to_numpy()[:cut], rest["class"].to_numpy()[:cut], samples,
                                  rest["tested"].slice(0, cut).combine_chunks(), most,
                                  *(rest[c].slice(0, cut).to_numpy() for c in ("seek", "sought")),
                                  unpacked(rest["sketch"].slice(0, cut).to_pylist()) if "sketch" in columns else None)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in np.concatenate(found).T], ["id", "other", "shared"])

    # Dealt by id once: for a pair found in several blocks, and for the best of a node.
    found = (rows.select(*columns).repartition("key", "block").sortWithinPartitions("key", "block")
             .mapInArrow(search, "id long, other long, shared long").repartition("id").dropDuplicates(["id", "other"]))
    if turns is not None:
        best = Window.partitionBy("id").orderBy(F.desc("shared"), "other")
        found = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= turns)
    return (found
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def linked(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough."""

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of each task its own, of bounded size besides one text
    room = [4 * PIECE]

    def known(text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in held:
            room[0] -= len(text)
            if room[0] < 0:
                held.clear()
                room[0] = 4 * PIECE
            held[text] = weighted(text, idf.value)
        return held[text]

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([jaccard(known(x.as_py()), known(y.as_py())) >= SIMILARITY for x, y in zip(left, right)], pa.bool_())

    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return stored(pairs.join(two, "b").join(one, "a").where(similar("text_a", "text_b")).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(id, class): the least id that can be reached, for every id on a link.

    Each round every node takes the least label among its own and its
    neighbours', and then the label of that label.
    """
    edges = stored_narrow(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored_narrow(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("class")))
    while True:
        near = edges.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("class").alias("low"))
        step = stored_narrow(label.join(near, F.col("id") == F.col("a"))
                      .select("id", F.col("class").alias("was"), F.least("class", "low").alias("class")))
        if step.where("was <> class").isEmpty():
            return step.select("id", "class")
        far = step.select(F.col("id").alias("class"), F.col("class").alias("far"))
        label = stored_narrow(step.select("id", "class").join(far, "class").select("id", F.col("far").alias("class")))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, class) after the classes on both ends of each link became one."""
    ends = links
    for c in "ab":
        ends = ends.join(label.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}")), c)
    ends = ends.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).where("a <> b").distinct()
    new = components(ends).select(F.col("id").alias("class"), F.col("class").alias("new"))
    return stored_narrow(label.join(new, "class", "left").select("id", F.coalesce("new", "class").alias("class")))


def past_partners(tested: DataFrame) -> DataFrame:
    """(id, tested): the partners of each node in the pairs (a, b); at most those of its ten blocks."""
    ends = tested.select(F.col("a").alias("id"), "b").union(tested.select("b", "a"))
    return ends.groupBy("id").agg(F.collect_list("b").alias("tested"))


def node_classes(nodes: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """(id, class) of the nodes (id, bands, samples) that share a bucket with another; docs has their texts (doc_id, text)."""
    buckets = bucketed(nodes)
    both = {"seek": F.lit(True), "sought": F.lit(True)}
    first = blocks(buckets).join(nodes.select("id", "samples"), "id") \
        .withColumns({"class": F.col("id"), "tested": F.lit(None).cast("array<long>"), **both})
    pairs = stored_narrow(candidates(first, PARTNERS, PARTNERS))
    # Only nodes with a candidate, or in a bucket that was not compared as a whole, can be on a link, now or later.
    ids = stored_narrow(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
                        .union(buckets.where(F.col("all") > BLOCK).select("id")).distinct())
    label = ids.select("id", F.col("id").alias("class"))
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("id"), whole_text(F.col("text")).alias("text"))
                   .join(ids, "id").groupBy("id").agg(F.min("text").alias("text")))  # one of repeated rows

    @F.arrow_udf("binary")
    def sketched(column: pa.Array) -> pa.Array:
        return pa.array([sketch(t.as_py(), idf.value) for t in column], pa.binary())

    members = stored(buckets.select("key", "id").join(
        nodes.select("id", "samples").join(texts.select("id", sketched("text").alias("sketch")), "id"), "id"))
    tested, whole = pairs, False
    while True:
        links = linked(pairs, texts, idf)
        found = links.count()
        if found:
            label = merged(label, links)
        if whole:  # no two nodes of a bucket in different classes are left untested
            return label
        whole = found * RARE < pairs.count()
        rows = spans(members.join(label.join(past_partners(tested), "id", "left"), "id"))
        pairs = stored_narrow(candidates(rows, None, None) if whole else candidates(rows, LATER_PARTNERS, PER_BLOCK))
        tested = tested.union(pairs)
        if pairs.isEmpty():
            return label


def _named_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, x1 and x2 of every row, and x1, x2, doc_id (the least of the text) and class of every text.

    A node is a text: it has a number of its own, so that texts without doc_id and different texts under one doc_id
    are nodes like any other.
    """
    small_batches(docs.sparkSession)
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(docs))
    rows = stored(signed(docs, idf))
    equal = stored(rows.groupBy("x1", "x2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("samples").alias("samples"))
                   .withColumn("id", F.monotonically_increasing_id()))  # written once: later reads see the same numbers
    texts = named_texts(docs).join(equal.select("x1", "x2", F.col("id").alias("doc_id")), ["x1", "x2"]).select("doc_id", "text")
    label = node_classes(equal.where("bands is not null").select("id", "bands", "samples"), texts, idf)
    return rows, stored(equal.select("x1", "x2", "doc_id", "id").join(label, "id", "left")
                        .select("x1", "x2", "doc_id", F.coalesce("class", "id").alias("class")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row of ``docs``."""
    rows, named = _named_classes(docs)
    least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = named.join(least, "class").select("x1", "x2", "class_id")
    return rows.select("doc_id", "x1", "x2").join(named, ["x1", "x2"]).select("doc_id", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Pipeline form: of each class only one row, that of the least doc_id (none comes last) and then the least text name."""
    rows, named = _named_classes(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("kept_id"), "x1", "x2")).alias("k")
    keep = named.groupBy("class").agg(first).select("k.kept_id", "k.x1", "k.x2")

    @F.arrow_udf("struct<x1:bigint,x2:bigint>")
    def name(texts: pa.Array) -> pa.Array:
        names = [text_names(word_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in texts]
        return pa.StructArray.from_arrays([pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)], ["x1", "x2"])

    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(F.struct(*cols).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    ids = keep.select("kept_id").distinct()
    found = found.join(ids, found["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")
    found = found.withColumn("name", name("row.text")).select("row", "doc_id", F.col("name.x1").alias("n1"), F.col("name.x2").alias("n2"))
    same = found["doc_id"].eqNullSafe(keep["kept_id"]) & (found["n1"] == keep["x1"]) & (found["n2"] == keep["x2"])
    kept = found.join(keep, same, "left_semi").dropDuplicates(["doc_id", "n1", "n2"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
