"""Line-first quality rules.

Every line of a text is judged alone; lines that fail a rule are removed, and
a document that loses too much of its text that way is rejected:

* symbols     more than half a sign of ``#*$%&|<>`` for each word
* navigation  three or more separators, with short entries between them
* shouting    mostly upper-case words, or mostly words with doubled marks
* repetition  words that mostly repeat the word before
* boilerplate a fixed notice (rights, cookies, scripts, placeholders)
* fragments   fewer than four words and no closing punctuation

The base figures (``n_words`` to ``n_repeat_words``) are of the whole text; a
text with fewer than 20 words, or with over 30 % of its words in repeated
8-word windows, fails the base rules whatever its lines say.

Defined results: a null or empty text has all figures 0, fails the base rules
and keeps no lines; rows are judged one by one, so repeated rows and ties need
no rule; other columns are never read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PCT = 30
# A document is rejected when it loses more than this share of its word characters.
MAX_LOST = 0.4

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_SPACE = b" \t\n\x0b\x0c\r"
# Bytes that do not start a code point, and white space.
_NO_CHAR = bytes(range(0x80, 0xC0)) + _SPACE
SEPARATORS = re.compile(r" ?[|»›·•] ?|\s[/>-]\s".encode())
NOTICE = re.compile(rb"all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript"
                    rb"|lorem ipsum|click here|subscribe to our|skip to (main )?content|powered by", re.I)
CLOSING = ('.', '!', '?', '"', '”', '…', '。', '！', '？', ':', ';', '»', "'", ')')


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    n_lines: int
    n_failed_lines: int
    lost_chars: int
    kept: bool
    clean_text: str


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more.

    Windows are named exactly by doubling: two equal names side by side make
    the name of a window twice as long.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    name = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    length = 1
    while length < window:
        pair = name[:-length] * (int(name.max()) + 1) + name[length:]
        uniq, name, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(uniq) == len(pair):
            return 0
        length *= 2
    edge = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(counts[name] > 1)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def failed_rule(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails."""
    n = len(words)
    symbols = len(line.translate(None, _NOT_SYMBOL))
    if symbols * 2 > n:
        return "symbols"
    if n >= 3:
        cuts = len(SEPARATORS.findall(line))
        if cuts >= 3 and n <= 4 * (cuts + 1):
            return "navigation"
    if n >= 5:
        if b"!!" in line or b"??" in line:
            if 2 * sum(w.endswith((b"!!", b"??")) for w in words) > n:
                return "shouting"
        if 10 * sum(map(bytes.isupper, words)) > 7 * n:
            return "shouting"
        if 10 * sum(map(bytes.__eq__, words, words[1:])) > 3 * n:
            return "repetition"
    if n <= 40 and NOTICE.search(line):
        return "boilerplate"
    if n < 4 and not line.decode("utf-8", "replace").rstrip().endswith(CLOSING):
        return "fragments"
    return None


def chars(data: bytes) -> int:
    """Code points that are not white space."""
    return len(data.translate(None, _NO_CHAR))


def judge(text: str | None) -> Verdict:
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    words: list[bytes] = []
    seen: set[bytes] = set()
    keep, dup, failed, lost = [], 0, 0, 0
    for line in lines:
        own = line.split()
        if own:
            words += own
            dup += line in seen
            seen.add(line)
            if failed_rule(line, own):
                failed += 1
                lost += chars(line)
                continue
        keep.append(line)
    total, n = chars(data), len(words)
    repeat = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED_PCT * n
    kept = not base_failed and lost <= MAX_LOST * total
    return Verdict(n, total, len(data.translate(None, _NOT_SYMBOL)), dup, repeat, base_failed, len(lines), failed, lost,
                   kept, b"\n".join(keep).decode("utf-8", "surrogatepass") if failed else text or "")


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_lines", "n_failed_lines", "lost_chars", "kept"]
_ARROW = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}


def _judge(fields: list[str]):
    spark_type = {"base_failed": "boolean", "kept": "boolean", "clean_text": "string"}
    schema = "struct<" + ",".join(f"{f}:{spark_type.get(f, 'bigint')}" for f in fields) + ">"

    @F.arrow_udf(schema)
    def line_rules(texts: pa.Array) -> pa.Array:
        found = [judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([getattr(v, f) for v in found], _ARROW.get(f, pa.int64())) for f in fields], fields)

    return line_rules


def figures(text: Column | str) -> Column:
    """The figures and verdict of a text, as a struct."""
    return _judge(FIGURES)(text)


def verdict(text: Column | str) -> Column:
    """The cleaned text and whether the document is kept, as a struct.

    Marked nondeterministic (it is not) so that a filter on ``kept`` is not
    pushed below it as a second evaluation of every text.
    """
    return _judge(["kept", "clean_text"]).asNondeterministic()(text)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of every document."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", figures("text").alias("q")).select("doc_id", "q.*")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Pipeline form: rejected documents go, kept ones lose their failed lines; same columns."""
    small_batches(docs.sparkSession)
    cols = docs.columns
    mark = "__line_rules"
    while mark in cols:
        mark += "_"
    out = docs.withColumn(mark, verdict("text")).where(F.col(f"{mark}.kept"))
    new = {"text": F.col(f"{mark}.clean_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.length(f"{mark}.clean_text") == F.length("text"), F.col("n_chars")) \
            .otherwise(F.length(f"{mark}.clean_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in cols])
