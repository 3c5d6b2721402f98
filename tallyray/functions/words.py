"""32-byte ABI words held as hex text -> typed columns, all JVM-side.

A log keeps its indexed arguments in ``topics[1..3]`` and the others as
consecutive 32-byte words of ``data`` (hex text with a ``0x`` prefix).  Spark's
``conv`` works on unsigned 64-bit values, so a uint256 word is read as 16-digit
limbs: ``hi * 2^64 + lo`` is exact in ``decimal(38,0)`` whenever the upper 128
bits are zero and ``hi < 2^62`` (the "fast path").  Anything wider yields null
on the fast path; :func:`tallyray.functions.uint256.of_word` reads it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

D38 = T.DecimalType(38, 0)
TWO64 = 18446744073709551616
TWO62 = 4611686018427387904
INT64_MAX = 9223372036854775807
ZERO_HEX_32 = "0" * 32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dlit(n: int, precision: int = 38) -> Column:
    """An exact integer literal of any size up to 38 digits as decimal(p,0)."""
    return F.expr(f"CAST('{int(n)}' AS DECIMAL({precision}, 0))")


def hex_body(x) -> Column:
    """Lower-case hex text without the ``0x`` prefix."""
    x = _c(x)
    return F.lower(F.when(F.substring(x, 1, 2).isin("0x", "0X"), F.substring(x, 3, 2 ** 31 - 1)).otherwise(x))


def data_word(data, i: int) -> Column:
    """The i-th (0-based) 32-byte word of a ``0x``-prefixed data string."""
    return F.substring(hex_body(data), 64 * i + 1, 64)


def n_data_words(data) -> Column:
    return F.floor(F.length(hex_body(data)) / 64).cast("int")


def is_word(w) -> Column:
    return _c(w).rlike("^[0-9a-f]{64}$")


def word_to_uint(w) -> Column:
    """uint256 word -> decimal(38,0) on the fast path, else null."""
    w = _c(w)
    hi = F.conv(F.substring(w, 33, 16), 16, 10).cast(T.DecimalType(20, 0))
    lo = F.conv(F.substring(w, 49, 16), 16, 10).cast(T.DecimalType(20, 0))
    fits = (F.substring(w, 1, 32) == F.lit(ZERO_HEX_32)) & (hi < F.lit(TWO62))
    val = (hi * dlit(TWO64, 20) + lo).cast(D38)
    # most words are below 2^64
    return F.when(is_word(w), F.when(F.substring(w, 1, 48) == F.lit("0" * 48), lo.cast(D38)).when(fits, val))


def word_fits_fast(w) -> Column:
    w = _c(w)
    hi = F.conv(F.substring(w, 33, 16), 16, 10).cast(T.DecimalType(20, 0))
    return is_word(w) & (F.substring(w, 1, 32) == F.lit(ZERO_HEX_32)) & (hi < F.lit(TWO62))


def word_to_long(w) -> Column:
    """uint256 word -> bigint; null when out of the signed 64-bit range."""
    v = word_to_uint(w)
    return F.when(v <= F.lit(INT64_MAX), v.cast("bigint"))


def word_to_bool(w) -> Column:
    """ABI bool: the word must be exactly 0 or 1, anything else is a decode failure."""
    v = word_to_uint(w)
    return F.when(v == 1, F.lit(True)).when(v == 0, F.lit(False))


def word_to_address(w) -> Column:
    """Last 20 bytes of a word as a ``0x`` address; null if the word is malformed."""
    w = _c(w)
    return F.when(is_word(w), F.concat(F.lit("0x"), F.substring(w, 25, 40)))


def topic_word(topics, i: int) -> Column:
    """Topic i (0-based) of an ``array<string>`` column as a bare hex word."""
    return hex_body(F.get(_c(topics), i))


def uint_to_word(x) -> Column:
    """Non-negative decimal(38,0) (or integral) -> 64-digit hex word (no prefix)."""
    x = _c(x).cast(D38)
    small = (x >= 0) & (x <= F.lit(INT64_MAX))
    # Decimal division rounds, so subtract the remainder first: the quotient is
    # then exact.
    rem = F.pmod(x, dlit(TWO64))
    hi = ((x - rem) / dlit(TWO64)).cast(D38)
    hi_hex = F.lpad(F.lower(F.conv(hi.cast("string"), 10, 16)), 16, "0")
    lo_hex = F.lpad(F.lower(F.conv(rem.cast("string"), 10, 16)), 16, "0")
    return F.when(small, F.lpad(F.lower(F.hex(x.cast("bigint"))), 64, "0")) \
        .otherwise(F.concat(F.lit(ZERO_HEX_32), hi_hex, lo_hex))


def address_to_word(a) -> Column:
    return F.concat(F.lit("0" * 24), F.substring(hex_body(a), 1, 40))


def config_bit(w, bit: int) -> Column:
    """Bit ``bit`` of a 256-bit word (bit 0 = least significant) as boolean."""
    pos = 64 - bit // 4  # 1-based position of the hex digit holding the bit
    digit = F.conv(F.substring(_c(w), pos, 1), 16, 10).cast("int")
    return F.shiftright(digit, bit % 4).bitwiseAND(F.lit(1)) == 1


def string_from_words(data, offset_word_index: int) -> Column:
    """Dynamic ABI string: an offset word (bytes from the start of data) pointing
    at a length word followed by the UTF-8 bytes."""
    body = hex_body(data)
    off = word_to_long(data_word(data, offset_word_index))
    start = (off * 2 + 1).cast("int")
    len_word = body.substr(start, F.lit(64))
    length = F.when(F.substring(len_word, 1, 48) == F.lit("0" * 48),
                    F.conv(F.substring(len_word, 49, 16), 16, 10).cast("int"))
    text = body.substr(start + F.lit(64), length * 2)
    return F.when(F.length(text) == length * 2, F.decode(F.unhex(text), "UTF-8"))


def wide_uint_text(w) -> Column:
    """Exact decimal text of any uint256 word; null if malformed."""
    from . import uint256
    return uint256.text(uint256.of_word(w))
