"""Where the character classes of the public tokenizers differ from those of
the ``regex`` and ``str`` of this Python."""

from __future__ import annotations

import re

# Letters and numbers of newer Unicode versions, which the
# tokenizer library's tables (Unicode 16) class as neither.
NEWER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
NEWER_NUMBERS = [
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6),
]
# Lower-case forms the tokenizer library knows and ``str.lower``
# of this Python does not, as (first, last, distance).
NEWER_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]


def _set(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


# Character classes for patterns of the ``regex`` module (version 1 sets).
LETTER = rf"[\p{{L}}--{_set(NEWER_LETTERS)}]"
NUMBER = rf"[\p{{N}}--{_set(NEWER_NUMBERS)}]"
OTHER = rf"[[^\s\p{{L}}\p{{N}}]||{_set(NEWER_LETTERS)}||{_set(NEWER_NUMBERS)}]"

# Lower case is taken character by character: no final sigma.
_LOWER = {c: c + d for a, b, d in NEWER_LOWER for c in range(a, b + 1)} | {0x3A3: 0x3C3}


def lower(text: str) -> str:
    return (text if text.isascii() else text.translate(_LOWER)).lower()


# The same classes spelt out for texts below U+0250, where plain character
# sets match much faster than properties.
LATIN_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
LATIN_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LATIN_SPACE = "\\t-\\r \\x85\\xa0"
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")
