"""Exact similarity join of documents by their word shingles: Jaccard >= 0.9 of sets of distinct 3-word shingles.

Method: a blocked product of the sparse incidence matrix of documents by n-grams with its transpose.

1. Every text becomes the set of 64-bit names of its shingles.  Equal sets are one node.
2. Only the columns of a node's prefix are multiplied: with size s, a partner shares at least ceil(0.9 s) n-grams,
   so two partners share one of the first s - ceil(0.9 s) + 1 of any common order.  The order is rare first, by
   document counts of 2^20 hashed bins over the whole corpus.
3. The nodes of a column make its block; columns with equal members are one.  A block over ``TILE`` nodes (or
   ``WEIGHT`` n-grams) is cut into parts, and every two parts with something left to compare are a tile.
4. In a tile the n-grams are first folded into parity bits: the bits in which two rows differ are a lower bound on
   the size of their symmetric difference, summed word by word; a pair beyond the bound that its sizes give is
   discarded.  The rows of the pairs left are multiplied exactly, column block by column block: overlap counts
   accumulate and a pair goes as soon as what is left cannot reach its bound.
5. Links merge classes; pairs of one class need no product.  Rounds take the most alike partners of each node, the
   last round every pair that is left between different classes of a block.  So no link between classes is lost, and
   a group of copies is not expanded into its pairs.

Scale: what is collected is 2^20 counts.  A tile is bounded by rows and n-grams; a block with a third of all nodes is
spread over its tiles.  Lists of a column are counted by partial aggregation.  Sets are made again from the texts of
nodes that share a column with another; all other texts are read twice and never shuffled.

Defined results: a null or empty text has an empty set (0 shingles) and is its own component.  Rows with equal sets
are linked, whatever their ids.  A component's id is its smallest doc_id; null if none of its rows has one.  Ties play
no part.  Empty tables give no rows, other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, stored_narrow
from .weighted_minhash import merged, mixed, word_hashes

WIDTH = 3
SHARE = 90  # per cent of the union
BIN_BITS, SLICE, FAN_IN = 22, 1 << 16, 512
LEAST_BITS, MOST_BITS = 256, 8192
TILE, WEIGHT = 1024, 1 << 20
FIRST, LATER = 2, 8  # partners of a node in the first and the following rounds
RARE = 8  # the last round comes when fewer than one in so many tested pairs is a link
SMALL = 1_000_000  # rows of 24 bytes that may be broadcast
COLUMNS = 1 << 14  # columns multiplied at a time

_U = np.uint64


# -- sets -------------------------------------------------------------------

def all_grams(text: str | None) -> np.ndarray:
    """The shingles of a text in its order; only A-Z are lower-cased."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    width = min(n, WIDTH)
    h = np.full(n - width + 1, width, _U)
    for k in range(width):
        h = h * _U(0xFF51AFD7ED558CCD) + words[k: n - width + 1 + k]
    return mixed(h)


def grams(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(all_grams(text))


def set_name(names: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    sums = [mixed(names ^ _U(k)).sum(dtype=_U) + _U(len(names)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(int(v) for v in mixed(np.array(sums)).view(np.int64))


def bins(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - BIN_BITS)).astype(np.int64)


def prefix(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest n-grams, so many that two linked sets share one."""
    n = len(names)
    return names[np.lexsort((names, counts[bins(names)]))[: n - (SHARE * n + 99) // 100 + 1]]


def parity(names: np.ndarray) -> bytes:
    """The set folded into bits: whether a bit's n-grams are odd in number."""
    bits = LEAST_BITS
    while bits < min(4 * len(names), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((names & _U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


# -- counts of the whole corpus ----------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts, a byte a bin (255 stands for more: the order stays one order for all)."""
    from pyspark import TaskContext

    total = np.zeros(1 << BIN_BITS, np.uint8)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            found, times = np.unique(bins(np.concatenate([all_grams(t.as_py()) for t in batch.column(0).slice(k, 256)])), return_counts=True)
            total[found] = np.minimum(total[found] + times, 255)
    cuts = [total[i: i + SLICE].tobytes() for i in range(0, len(total), SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()),
                                      pa.array(cuts, pa.binary())], ["part", "slice", "counts"])


def _summer(wide: bool):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for c in pdf.counts:
            total += np.frombuffer(c, "<i8" if wide else np.uint8)
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN_IN], "slice": [int(pdf["slice"].iloc[0])], "counts": [total.tobytes()]})

    return add


def bin_counts(docs: DataFrame) -> np.ndarray:
    """How many n-grams fall into each bin, added ``FAN_IN`` tasks at a time."""
    schema = "part long, slice int, counts binary"
    parts = docs.select("text").mapInArrow(_count, schema)
    for wide in (False, True):
        parts = parts.groupBy("slice", F.expr(f"part div {FAN_IN}")).applyInPandas(_summer(wide), schema)
    total = np.zeros(1 << BIN_BITS, np.int64)
    for r in parts.select("slice", "counts").collect():  # 64 rows for each 262,144 tasks
        total[r["slice"] * SLICE: (r["slice"] + 1) * SLICE] += np.frombuffer(r["counts"], "<i8")
    return np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)


# -- nodes and blocks --------------------------------------------------------

def named(docs: DataFrame, counts) -> DataFrame:
    """doc_id, n, x1, x2, prefix, bits of every row; ``counts`` is a broadcast."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                g = grams(t.as_py())
                rows.append((len(g), *set_name(g), prefix(g, counts.value).view(np.int64) if len(g) else None, parity(g) if len(g) else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]] if rows else
                                             [batch.column(0), *[pa.array([], t) for t in types]], ["doc_id", "n", "x1", "x2", "prefix", "bits"])

    return docs.mapInArrow(name, "doc_id long, n long, x1 long, x2 long, prefix array<long>, bits binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, id, n, parts) of the blocks with two or more nodes, one of those with equal members.

    A block is a column within two neighbouring bands of sizes: sets of linked documents are at most one band apart.
    """
    rows = nodes.select("id", "n", F.explode("prefix").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    band = F.floor(F.log("n") / F.lit(math.log(100 / SHARE) * (1 + 1e-9)))
    rows = stored_narrow(rows.join(shared, "key").withColumn("band", F.explode(F.array(band, band + 1)))
                         .select(F.xxhash64("key", "band").alias("key"), "id", "n"))
    part = lambda seed: F.sum(F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 16))
    columns = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), part(1).alias("s1"), part(2).alias("s2")).where("m > 1")
    one = columns.groupBy("m", "weight", "s1", "s2").agg(F.min("key").alias("key")).select("key", "m", "weight")
    parts = F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("weight") / WEIGHT))
    return stored_narrow(rows.join(one, "key").select("key", "id", "n", parts.alias("parts")))


def sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, names) of the nodes ``ids``, made from their texts."""
    wanted = nodes.join(ids, "id", "left_semi").select("id", "x1", "x2", F.col("least").alias("doc_id"))
    few = wanted.limit(SMALL + 1).count() <= SMALL
    keys = wanted.select("doc_id").distinct()
    found = docs.join(F.broadcast(keys) if few else keys, docs["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                got = [grams(t.as_py()) for t in batch.column(1).slice(k, 64)]
                named_sets = [set_name(g) for g in got]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in named_sets], pa.int64()) for j in (0, 1)] +
                                                 [pa.array([g.astype("<u8").tobytes() for g in got], pa.binary())], ["x1", "x2", "names"])

    made = found.mapInArrow(make, "x1 long, x2 long, names binary")
    keys = wanted.select("id", "x1", "x2")
    return stored(made.join(F.broadcast(keys) if few else keys, ["x1", "x2"]).dropDuplicates(["id"]).select("id", "names"))


def tiles(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """(key, tile, id, n, class, part, seek) of the tiles with pairs left to compare.

    Without labels: the first round, in which each part of a block meets itself.  With labels all nodes of a block
    that are not of its largest class seek, and a part with a seeker meets every part.
    """
    rows = members.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")))
    if label is None:
        return rows.select("key", F.col("part").alias("tile"), "id", "n", F.col("id").alias("class"), "part", F.lit(True).alias("seek"))
    rows = rows.join(label, "id")
    tops = rows.groupBy("key", "class").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "class")).alias("top"), F.sum("c").alias("m"))
    left = rows.join(tops.where("top.c < m").select("key", F.col("top.class").alias("top")), "key").withColumn("seek", F.expr("class <> top"))
    active = left.groupBy("key").agg(F.collect_set(F.when(F.col("seek"), F.col("part"))).alias("active"))
    others = F.when(F.array_contains("active", F.col("part")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.col("active"))
    return left.join(active, "key").withColumn("other", F.explode(others)).select(
        "key", (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("tile"), "id", "n", "class", "part", "seek")


# -- products ----------------------------------------------------------------

def _rows(bits: list[bytes], width: int) -> np.ndarray:
    """Parity rows as 64-bit words, wider ones folded to ``width`` bytes."""
    out = np.empty((len(bits), width // 8), _U)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, "<u8")
        while len(row) * 8 > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2:]
        out[i] = row
    return out


def close_pairs(n: np.ndarray, bits: list[bytes], group: np.ndarray, part: np.ndarray, seek: np.ndarray, ids: np.ndarray,
                most: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of pairs of different classes that their sizes and folded rows allow: of every seeker the ``most`` closest,
    or all; and whether any were left out."""
    across = len(np.unique(part)) > 1  # pairs inside a part are compared in the part's own tile
    widths = np.array([len(b) for b in bits])
    found: list[np.ndarray] = []
    cut = False
    for w in np.unique(widths):
        mine, near = np.flatnonzero((widths == w) & seek), np.flatnonzero((widths == w) | (widths == 2 * w) | (widths == w // 2))
        for own, least in ((near[widths[near] >= w], w), (near[widths[near] < w], w // 2)):
            if not len(own) or not len(mine):
                continue
            theirs = _rows([bits[j] for j in own], least)
            for lo in range(0, len(mine), 256):
                x = mine[lo: lo + 256]
                rows = _rows([bits[i] for i in x], least)
                apart = np.zeros((len(x), len(own)), np.int64)
                for k in range(rows.shape[1]):  # counts accumulate, 64 columns at a time
                    apart += np.bitwise_count(rows[:, k, None] ^ theirs[None, :, k])
                size = n[x, None] + n[None, own]
                # |x ^ y| <= (1 - s) / (1 + s) (|x| + |y|), and sizes no further apart than s
                fits = apart * (100 + SHARE) <= size * (100 - SHARE)
                fits &= np.minimum(n[x, None], n[None, own]) * 100 >= np.maximum(n[x, None], n[None, own]) * SHARE
                fits &= group[x, None] != group[None, own]
                if across:
                    fits &= part[x, None] != part[None, own]
                if most is not None and (fits.sum(1) > most).any():
                    cut = True
                    turn = (mixed(ids[x, None].astype(_U) ^ mixed(ids[None, own].astype(_U))) >> _U(50)).astype(np.int64)
                    rank = np.where(fits, apart * (1 << 14) + turn, np.iinfo(np.int64).max)
                    order = np.argpartition(rank, most - 1, 1)[:, :most]
                    i = np.repeat(np.arange(len(x)), most)
                    j = order.ravel()
                    keep = fits[i, j]
                    i, j = i[keep], j[keep]
                else:
                    i, j = np.nonzero(fits)
                found.append(np.column_stack([x[i], own[j]]))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    pairs = np.unique(np.sort(pairs, 1), axis=0)
    return pairs[:, 0], pairs[:, 1], cut


def overlapping(sets_of: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of places (a, b) are links, by the product of their incidence rows."""
    sizes = np.array([len(s) for s in sets_of])
    row = np.repeat(np.arange(len(sets_of)), sizes)
    names, column, times = np.unique(np.concatenate(sets_of), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)  # a column of one row adds nothing
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    need = -(-SHARE * (sizes[a] + sizes[b]) // (100 + SHARE))
    live, count = np.arange(len(a)), np.zeros(len(a), np.int64)
    rest = np.bincount(row, minlength=len(sets_of))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(shared), COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        block = np.zeros((len(sets_of), -(-min(COLUMNS, len(shared) - lo) // 64) * 64), bool)
        block[row[at], column[at] - lo] = True
        words = np.packbits(block, axis=1).view(_U)
        rest = rest - np.bincount(row[at], minlength=len(sets_of))
        for k in range(0, len(live), 4096):
            p = live[k: k + 4096]
            count[p] += np.bitwise_count(words[a[p]] & words[b[p]]).sum(1, dtype=np.int64)
        live = live[count[live] + np.minimum(rest[a[live]], rest[b[live]]) >= need[live]]
    ok = np.zeros(len(a), bool)
    ok[live] = count[live] >= need[live]
    return ok


def candidates(rows: DataFrame, nodes: DataFrame, most: int | None) -> DataFrame:
    """(key, tile, a, b, cut): pairs of a tile, and whether it left some out."""

    def search(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        a, b, cut = close_pairs(table["n"].to_numpy(), table["bits"].to_pylist(), table["class"].to_numpy(), table["part"].to_numpy(),
                           table["seek"].to_numpy(zero_copy_only=False), ids, most)
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        return pa.table({"key": pa.array(np.full(len(a), table["key"][0].as_py())), "tile": pa.array(np.full(len(a), table["tile"][0].as_py())),
                         "a": pa.array(low), "b": pa.array(high), "cut": pa.array(np.full(len(a), cut))})

    found = rows.join(nodes.select("id", "bits"), "id").groupBy("key", "tile").applyInArrow(search, "key long, tile long, a long, b long, cut boolean")
    return stored_narrow(found)


def links(pairs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """The linked among the pairs (key, tile, a, b); a tile gets each set once."""
    ends = pairs.select(F.col("key").alias("of_key"), F.col("tile").alias("of_tile"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets_of, "id")

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["id"].to_numpy()
        if not left.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(ids)
        names = [np.frombuffer(v.as_py(), "<u8") for v in right["names"]]
        a, b = (order[np.searchsorted(ids, left[c].to_numpy(), sorter=order)] for c in "ab")
        ok = overlapping(names, a, b)
        return pa.table({"a": pa.array(ids[a[ok]]), "b": pa.array(ids[b[ok]])})

    return stored_narrow(pairs.groupBy("key", "tile").cogroup(ends.groupBy("of_key", "of_tile")).applyInArrow(multiply, "a long, b long"))


def node_classes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, class) of the nodes that share a column with another."""
    members = blocks(nodes)
    label = stored_narrow(members.select("id", F.col("id").alias("class")).distinct())
    rows = stored(nodes.join(label, "id", "left_semi").select("id", "bits"))
    sets_of, first, whole = None, True, False
    while True:
        found = candidates(tiles(members, None if first else label), rows, FIRST if first else None if whole else LATER)
        pairs = found.groupBy("a", "b").agg(F.min(F.struct("key", "tile")).alias("at")).select("at.key", "at.tile", "a", "b")
        pairs = stored_narrow(pairs)  # each pair in one of the tiles that found it
        tested, linked = pairs.count(), 0
        if tested:
            ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            new = stored_narrow(ends if sets_of is None else ends.join(sets_of, "id", "left_anti"))
            if not new.isEmpty():
                more = sets(docs, nodes, new)
                sets_of = more if sets_of is None else sets_of.unionByName(more)
            close = links(pairs, sets_of)
            linked = close.count()
        if linked:
            label = merged(label, close)
        # A block is done when all its parts have met and no tile left a pair of two classes out.
        left = found.where("cut").select("key")
        left = left.union(members.where("parts > 1").select("key")) if first else left
        if whole or left.isEmpty():
            return label
        members = stored_narrow(members.join(left.distinct(), "key", "left_semi"))
        whole, first = not first and linked * RARE < tested, False


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(bin_counts(docs))
    rows = stored(named(docs, counts))
    nodes = stored(rows.where("n > 0").groupBy("x1", "x2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"),
                                                              F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
                   .withColumn("id", F.monotonically_increasing_id()))
    label = node_classes(nodes, docs)
    of = nodes.select("id", "x1", "x2", "least").join(label, "id", "left").withColumn("class", F.coalesce("class", "id"))
    of = stored(of.select("x1", "x2", "least", "class"))
    least = of.groupBy("class").agg(F.min("least").alias("component_id"))
    named_sets = of.join(least, "class").select("x1", "x2", "component_id")
    return rows.select("doc_id", "n", "x1", "x2").join(named_sets, ["x1", "x2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
