"""Token counts from a tokenizer compiled to deterministic transducers.

Two transducers, both determinised, give the number of tokens of a text
without building the tokens:

* the *cutter* reads characters and marks the ends of words.  Its states are
  the kinds of an open word (none, letters, other signs);
* the *word transducer* reads the symbols of one word.  For each prefix of a
  word the merges leave exactly one possible last token, and which one it is
  depends only on the suffixes of the prefix that can still grow into a token,
  the last token before each of them, and their token counts relative to each
  other.  That is the state; it is finite and found lazily, as symbols ask for
  it.  Each transition carries the change in the number of emitted tokens, so
  the count of a word is the sum over its path.

A text is read in chunks.  What a chunk does to any state before it is its
*state map*: the characters before its first word end (they belong to the word
that is open when it begins), the tokens between its first and last word end,
and the characters left open at its end.  A chunk without a word end maps every
state to itself plus its characters.  State maps compose associatively, so the
chunks of all texts of a batch are combined by a prefix scan in log-many rounds
of neighbours, whatever the length of a text.

Defined results: a null text is the empty text and has 0 tokens; special
tokens inside a text count one each, as in the library by default; a document
is over the limit if it has more tokens than ``limit``.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Merges, Words, byte_symbols, read_spec
from .common import small_batches
from .unicode_tables import BEYOND_LATIN, LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE, LETTER, NUMBER, OTHER, lower

CHUNK = 1 << 14
MAX_STATES = 1 << 17

WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+", regex.V1)
LATIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN_LETTER}]+|[{LATIN_NUMBER}]|[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+")


class WordTransducer:
    """Token counts of single words, by lazily determinised transitions.

    A state is (suffix, spans): ``suffix`` is the longest end of the symbols
    read that may still grow into a token, and each span is (length, last
    token before it or -1, tokens before it less the tokens of the whole).
    """

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str) -> None:
        self.merges = Merges(vocab, merges)
        symbols = byte_symbols()
        first = {b: vocab[symbols[b]] for b in range(256)}
        last = {b: vocab[symbols[b] + word_end] for b in range(256)}
        self.first, self.last = first, last
        # A token as the string of its symbols: the byte, or the byte + 256 at a word's end.
        byte_of = {s: b for b, s in symbols.items()}
        self.tokens: dict[str, int] = {}
        grown = {*(first[b] for b in range(256)), *(last[b] for b in range(256)), *self.merges.merged}
        for text, i in vocab.items():
            ends = text.endswith(word_end)
            body = text[: -len(word_end)] if ends else text
            if i in grown and body and all(c in byte_of for c in body):
                codes = [byte_of[c] for c in body]
                if ends:
                    codes[-1] += 256
                self.tokens["".join(map(chr, codes))] = i
        self.parts = {i: self._symbols(t) for t, i in self.tokens.items()}
        # Only tokens that their own symbols merge into can ever be emitted.
        self.tokens = {t: i for t, i in self.tokens.items() if self.merges.apply([*self.parts[i]]) == [i]}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Only the state before any symbol is known."""
        self.states = [("", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _symbols(self, token: str) -> list[int]:
        return [self.first[ord(c)] if ord(c) < 256 else self.last[ord(c) - 256] for c in token]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a: their symbols merge to just these two."""
        if a < 0:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merges.apply([*self.parts[a], *self.parts[b]]) == [a, b]
        return known

    def _step(self, state, symbol: str):
        """The next state and the change in emitted tokens."""
        suffix, spans = state
        longer = suffix + symbol
        token, change = next((t, before + 1) for n, was, before in spans
                             if (t := self.tokens.get(longer[len(suffix) - n:])) is not None and self._may_follow(was, t))
        kept = [(n + 1, was, before - change) for n, was, before in spans
                if longer[len(suffix) - n:] in self.prefixes]
        kept.append((0, token, 0))
        longest = kept[0][0]
        return (longer[len(longer) - longest:], tuple(kept)), change

    def _find(self, at: int, code: int) -> tuple[int, int]:
        """A transition asked for the first time."""
        state, change = self._step(self.states[at], chr(code))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        self.steps[at][code] = to, change
        return to, change

    def count(self, word: str) -> int:
        """Tokens of a word; its last byte reads as the symbol of a word's end."""
        data = word.encode("utf-8")
        if len(self.states) >= MAX_STATES:
            self._forget()
        steps, at, total = self.steps, 0, 0
        for code in data[:-1]:
            at, change = steps[at].get(code) or self._find(at, code)
            total += change
        # What follows a word's end is no state of its own: only its count is kept.
        end = data[-1] + 256
        step = steps[at].get(end)
        if step is None:
            step = steps[at][end] = 0, self._step(self.states[at], chr(end))[1]
        return total + step[1]


class StateMap(NamedTuple):
    """What a chunk does to the state before it. ``head`` is open at both ends if the chunk has no word end."""

    head: str
    tokens: int
    tail: str | None  # None: no word end inside


class Counter:
    """A compiled tokenizer file: texts to token counts."""

    def __init__(self, spec: str, chunk: int = CHUNK) -> None:
        conf = json.loads(spec)
        model = conf["model"]
        self.words = Words(WordTransducer(model["vocab"], model["merges"], model["end_of_word_suffix"]).count)
        special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.special = set(special)
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.chunk = chunk

    def _tokens(self, text: str) -> int:
        return sum(map(self.words.__getitem__, (WORDS if BEYOND_LATIN.search(text) else LATIN_WORDS).findall(text)))

    def state_map(self, chunk: str) -> StateMap:
        """White space ends any word and leaves no open one, so the map is fixed between the first and the last."""
        if (start := SPACE.search(chunk)) is None:
            return StateMap(chunk, 0, None)
        end = next(i for i in range(len(chunk), 0, -1) if chunk[i - 1].isspace() and SPACE.match(chunk[i - 1]))
        return StateMap(chunk[: start.start()], self._tokens(chunk[start.end(): end]), chunk[end:])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b."""
        if a.tail is None and b.tail is None:
            return StateMap(a.head + b.head, 0, None)
        if a.tail is None:
            return StateMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.tokens, a.tail + b.head)
        return StateMap(a.head, a.tokens + self._tokens(a.tail + b.head) + b.tokens, b.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed in order, neighbours first."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        total = 0
        for part in self.split.split(text) if self.split and "<|" in text else (text,):
            if part in self.special:
                total += 1
            elif part:
                part = lower(part if part.isascii() else unicodedata.normalize("NFC", part))
                whole = self.scan([self.state_map(part[i: i + self.chunk]) for i in range(0, len(part), self.chunk)])
                total += whole.tokens + self._tokens(whole.head) + self._tokens(whole.tail or "")
        return total


SPACE = regex.compile(r"\s")


@functools.lru_cache(maxsize=2)
def compiled(spec: str) -> Counter:
    return Counter(spec)


def token_count(spark: SparkSession, text: Column | str, path: str) -> Column:
    """Tokens of a text (long) under a BPE file with word ends."""
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("long")
    def count_tokens(texts: pa.Array) -> pa.Array:
        model = compiled(spec.value)
        return pa.array([model.count(t.as_py() or "") for t in texts], pa.int64())

    return count_tokens(text)


def counted(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return (docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        token_count(docs.sparkSession, "text", path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
