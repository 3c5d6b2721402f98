"""Byte-level BPE encoding and decoding.

``encode`` / ``decode`` / ``encode_decode`` are column functions; the
vocabulary file is read once on the driver (its path is a parameter), shipped
as a broadcast (its size is checked) and compiled once per Python worker.

Words (the pieces of the file's pre-tokenizer) are merged on a contiguous rank
array: the part boundaries of the word and, beside each, the rank of the merge
of its two neighbours.  The array is scanned for its minimum, the boundary
there is deleted, and the two ranks next to it are refreshed, until no
adjacent pair has a rank.  Words repeat, so each worker keeps the parts of the
words it met in a bounded dictionary.

Defined results: a null text is the empty text; the empty text has no tokens
and decodes to itself; special tokens in a text are single ids, as the library
treats them by default; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .unicode_tables import BEYOND_LATIN, LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, LETTER, NUMBER, OTHER

NO_RANK = 1 << 60
# Words longer than this are merged with a heap: the scan takes time in the
# square of the length.
SCAN_LIMIT = 96
CACHE_WORDS = 1 << 17
# A tokenizer file beyond this size is refused rather than broadcast.
MAX_SPEC_BYTES = 64 << 20

PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+", regex.V1)
LATIN_PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+"
    rf"| ?[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")


def pieces(text: str) -> list[str]:
    """The words of a text as the file's pre-tokenizer cuts them."""
    return (PIECES if BEYOND_LATIN.search(text) else LATIN_PIECES).findall(text)


def read_spec(path: str) -> str:
    """The JSON text of a tokenizer file, its size checked for a broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_SPEC_BYTES:
        raise ValueError(f"{path}: larger than {MAX_SPEC_BYTES} bytes")
    return spec


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for a byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merge table of a BPE file, by ids of the two parts."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = k
            self.merged.append(vocab[a + b])

    def apply(self, parts: list[int]) -> list[int]:
        """The parts of a word after all merges."""
        if len(parts) > SCAN_LIMIT:
            return self._apply_long(parts)
        rank, merged = self.rank, self.merged
        find = lambda i: rank.get(parts[i] << 32 | parts[i + 1], NO_RANK)
        ranks = [find(i) for i in range(len(parts) - 1)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(i)
            if i:
                ranks[i - 1] = find(i - 1)
        return parts

    def _apply_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order (lowest rank, then leftmost) from a heap of boundaries."""
        rank, merged = self.rank, self.merged
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], alive[j] = merged[r], False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0:
                    b = after[a]
                    if (q := rank.get(parts[a] << 32 | parts[b])) is not None:
                        heapq.heappush(heap, (q, a, parts[a], parts[b]))
        return [p for p, live in zip(parts, alive) if live]


class Words(dict):
    """Parts of the words met so far, computed on first sight; bounded."""

    def __init__(self, parts_of) -> None:
        super().__init__()
        self.parts_of = parts_of

    def __missing__(self, word: str):
        parts = self.parts_of(word)
        if len(word) <= SCAN_LIMIT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = parts
        return parts


class ByteBpe:
    """A compiled byte-level BPE file."""

    def __init__(self, spec: str) -> None:
        conf = json.loads(spec)
        vocab = conf["model"]["vocab"]
        self.merges = Merges(vocab, conf["model"]["merges"])
        symbols = byte_symbols()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        byte_of = {s: b for b, s in symbols.items()}
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = Words(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(self.merges.apply([self.byte_id[b] for b in word.encode("utf-8")]))

    def encode(self, text: str) -> array:
        out = array("i")
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(self.cache.__getitem__, pieces(part))))
        return out

    def decode(self, ids) -> str:
        known = self.bytes_of
        return b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def compiled(spec: str) -> ByteBpe:
    return ByteBpe(spec)


class IdLists:
    """Lists of ids, gathered in one buffer and handed over without a copy."""

    def __init__(self) -> None:
        self.flat, self.ends = array("i"), [0]

    def add(self, ids: array) -> None:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def arrow(self) -> pa.Array:
        values = pa.Array.from_buffers(pa.int32(), len(self.flat), [None, pa.py_buffer(self.flat)])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values)


def _texts(texts: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in texts)


def encode(spark: SparkSession, text: Column | str, path: str) -> Column:
    """The token ids of a text: array<int>."""
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        model = compiled(spec.value)
        lists = IdLists()
        for t in _texts(texts):
            lists.add(model.encode(t))
        return lists.arrow()

    return bpe_encode(text)


def decode(spark: SparkSession, ids: Column | str, path: str) -> Column:
    """The text of token ids; null ids give the empty text."""
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("string")
    def bpe_decode(rows: pa.Array) -> pa.Array:
        model = compiled(spec.value)
        return pa.array([model.decode(r.as_py() or ()) for r in rows], pa.string())

    return bpe_decode(ids)


def encode_decode(spark: SparkSession, text: Column | str, path: str) -> Column:
    """Both at once, from one pass over the texts: struct<ids array<int>, decoded string>."""
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        model = compiled(spec.value)
        lists, decoded = IdLists(), pa.lib.StringBuilder()
        for t in _texts(texts):
            ids = model.encode(t)
            lists.add(ids)
            decoded.append(model.decode(ids))
        return pa.StructArray.from_arrays([lists.arrow(), decoded.finish()], ["ids", "decoded"])

    return bpe_round_trip(text)


def encode_checked(spark: SparkSession, text: Column | str, path: str) -> Column:
    """struct<ids array<int>, round_trip boolean>: the ids, and whether they decode to the text again."""
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def bpe_checked(texts: pa.Array) -> pa.Array:
        model = compiled(spec.value)
        lists, same = IdLists(), []
        for t in _texts(texts):
            ids = model.encode(t)
            lists.add(ids)
            same.append(model.decode(ids) == t)
        return pa.StructArray.from_arrays([lists.arrow(), pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return bpe_checked(text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    trip = encode_decode(docs.sparkSession, F.col("text"), path)
    return (docs.select("doc_id", trip.alias("trip"))
            .select("doc_id", "trip.*")
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded"), 256).alias("decoded_sha256")))


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pipeline form: each document's id, text, token ids and whether the decoded text is the text again."""
    trip = encode_checked(docs.sparkSession, F.col("text"), path)
    return (docs.select("doc_id", "source", "text", trip.alias("trip"))
            .select("doc_id", "source", "text", F.size("trip.ids").cast("long").alias("n_tokens"), "trip.ids", "trip.round_trip"))
