"""Keccak-256 (the pre-standard SHA-3 padding used by EVM chains).

A small per-value helper: Spark has no Keccak function.  It is used for the
mixed-case checksum text of addresses (run once per *distinct* address inside
an Arrow pandas UDF) and to verify the fixed topic table in tests.  Round
constants and rotation offsets are generated from their defining rules.
"""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _rc_bit(t: int) -> int:
    # LFSR x^8 + x^6 + x^5 + x^4 + 1
    r = 1
    for _ in range(t % 255):
        r <<= 1
        if r & 0x100:
            r ^= 0x171
    return r & 1


def _round_constants() -> list[int]:
    out = []
    for i in range(24):
        c = 0
        for j in range(7):
            if _rc_bit(j + 7 * i):
                c |= 1 << ((1 << j) - 1)
        out.append(c)
    return out


def _rotations() -> list[list[int]]:
    rot = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        rot[x][y] = ((t + 1) * (t + 2) // 2) % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rot


_RC = _round_constants()
_ROT = _rotations()


def _rol(v: int, n: int) -> int:
    n %= 64
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[list[int]]) -> list[list[int]]:
    for rc in _RC:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[(x - 1) % 5] ^ _rol(c[(x + 1) % 5], 1) for x in range(5)]
        a = [[a[x][y] ^ d[x] for y in range(5)] for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rol(a[x][y], _ROT[x][y])
        a = [[b[x][y] ^ ((~b[(x + 1) % 5][y]) & _MASK & b[(x + 2) % 5][y])
              for y in range(5)] for x in range(5)]
        a[0][0] ^= rc
    return a


def keccak256(data: bytes) -> bytes:
    rate = 136
    msg = bytearray(data)
    msg.append(0x01)
    while len(msg) % rate:
        msg.append(0)
    msg[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for off in range(0, len(msg), rate):
        block = msg[off:off + rate]
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(block[8 * i:8 * i + 8], "little")
        a = _permute(a)
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def topic0(signature: str) -> str:
    return "0x" + keccak256(signature.encode()).hex()


def checksum(address: str | None) -> str | None:
    """Mixed-case checksum text of a 20-byte hex address; None if malformed."""
    if address is None:
        return None
    body = address.lower().removeprefix("0x")
    if len(body) != 40 or any(ch not in "0123456789abcdef" for ch in body):
        return None
    h = keccak256(body.encode()).hex()
    return "0x" + "".join(ch.upper() if ch.isalpha() and int(h[i], 16) >= 8 else ch
                          for i, ch in enumerate(body))
