"""Exact integers beyond 38 digits as columns of limbs, all JVM-side.

A wide amount is ``struct<h,m,l>`` of decimal(38,0) limbs with the value
``h * 10^54 + m * 10^27 + l``.  Normalised, ``m`` and ``l`` lie in
[0, 10^27) and ``h`` carries the sign.  The base is the ray unit: scaling by
10^27 moves every limb up one place, decimal text is the limbs one after the
other, and a limb summed over 10^11 rows still fits 38 digits -- so sums and
running sums are plain sums per limb with one carry pass at the end.

The 78 digits of 2^256 - 1 need all three limbs.  ``ray_div`` divides in base
10^9 with a trial quotient from doubles that is off by one at most; it
sits behind the 38-digit path and is only evaluated for rows beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import dlit, is_word

DIGITS = 27
BASE = 10 ** DIGITS
STEP = 10 ** 9
MAX = 2 ** 256 - 1
D38 = "decimal(38,0)"  # as text: one driver call a cast
LIMBS = "struct<h:decimal(38,0),m:decimal(38,0),l:decimal(38,0)>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split(n: int) -> tuple[int, int, int]:
    """The normalised limbs of a Python integer."""
    return n // BASE ** 2, n // BASE % BASE, n % BASE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def limbs(h, m, l) -> Column:
    return F.struct(h.cast(D38).alias("h"), m.cast(D38).alias("m"), l.cast(D38).alias("l"))


def constant(n: int) -> Column:
    return F.expr("named_struct(" + ", ".join(f"'{k}', CAST('{x}' AS DECIMAL(38, 0))" for k, x in zip("hml", split(n))) + ")")


def carried(h: Column, m: Column, l: Column) -> Column:
    """Normalised limbs from limbs of any sign and size (below 10^38)."""
    base = dlit(BASE)
    up = lambda x: F.call_function("div", x - F.pmod(x, base), base)  # noqa: E731  floor, also below zero; a long: x below 10^45
    low = lambda v: F.struct(v["h"].alias("h"), (v["m"] + up(v["l"])).cast(D38).alias("m"), F.pmod(v["l"], base).alias("l"))
    return let(let(limbs(h, m, l), low), lambda v: limbs(v["h"] + up(v["m"]), F.pmod(v["m"], base), v["l"]))


def of_decimal(x) -> Column:
    """decimal(38,0) or integral -> limbs; null stays."""
    zero = dlit(0)

    def split_up(v: Column) -> Column:
        # 0 - v, not -v: Spark's unary minus and abs round decimals to 34 digits
        size = let(F.when(v < 0, (zero - v).cast(D38)).otherwise(v), lambda p: carried(zero, zero, p))
        return F.when(v < 0, let(size, lambda s: carried(-s["h"], -s["m"], -s["l"]))).when(v >= 0, size)

    return let(_c(x).cast(D38), split_up)


def of_word(w) -> Column:
    """uint256 word (64 hex digits) -> limbs; null if malformed."""
    w = _c(w)
    pieces = [F.conv(F.substring(w, 57 - 8 * j, 8), 16, 10).cast("decimal(10,0)") for j in range(8)]
    places = [split(2 ** (32 * j)) for j in range(8)]
    sums = []
    for k in range(3):
        total = dlit(0)
        for p, place in zip(pieces, places):
            if place[k]:
                total = (total + p * dlit(place[k], DIGITS)).cast(D38)
        sums.append(total)
    return F.when(is_word(w), carried(*sums))


def of_text(x) -> Column:
    """Decimal text of up to 81 digits, with or without a minus sign -> limbs; null for any other text."""
    x = F.trim(_c(x))
    body = F.lpad(F.regexp_replace(x, "^-?0*", ""), 3 * DIGITS, "0")
    part = lambda k: F.substring(body, 1 + k * DIGITS, DIGITS).cast(D38)
    fits = x.rlike(r"^-?[0-9]+$") & (F.length(F.regexp_replace(x, "^-?0*", "")) <= 3 * DIGITS)
    return F.when(fits, F.when(x.startswith("-"), carried(-part(0), -part(1), -part(2))).otherwise(limbs(part(0), part(1), part(2))))


def is_negative(x) -> Column:
    return _c(x)["h"] < 0


def is_zero(x) -> Column:
    x = _c(x)
    return (x["h"] == 0) & (x["m"] == 0) & (x["l"] == 0)


def total(*terms: tuple[int, Column]) -> Column:
    """The sum of (sign, limbs) terms, normalised once; null if one is null."""

    def add(xs: Column) -> Column:
        acc = [dlit(0)] * 3
        for j, (sign, _) in enumerate(terms):
            acc = [(a + xs[j][k] if sign > 0 else a - xs[j][k]).cast(D38) for a, k in zip(acc, "hml")]
        return F.when(F.forall(xs, lambda v: v.isNotNull()), carried(*acc))

    return let(F.array(*[x for _, x in terms]), add)


def magnitude(x) -> Column:
    return let(_c(x), lambda v: F.when(is_negative(v), carried(-v["h"], -v["m"], -v["l"])).otherwise(v))


def text(x) -> Column:
    """Normalised limbs -> decimal text."""

    def digits(v: Column) -> Column:
        padded = F.concat(*[F.lpad(v[k].cast("string"), DIGITS, "0") for k in "hml"])
        return F.coalesce(F.nullif(F.regexp_replace(padded, "^0+", ""), F.lit("")), F.lit("0"))

    return let(_c(x), lambda v: F.when(v.isNotNull(), F.concat(F.when(is_negative(v), "-").otherwise(""), let(magnitude(v), digits))))


def decimal(x) -> Column:
    """Limbs -> decimal(38,0), null when it has more digits."""

    def joined(v: Column, size: Column) -> Column:
        room = (size["h"] == 0) & (size["m"] < dlit(10 ** 11))
        return F.when(room, (F.when(is_negative(v), -1).otherwise(1) * (size["m"] * dlit(BASE, 28) + size["l"])).cast(D38))

    return let(_c(x), lambda v: let(magnitude(v), lambda size: joined(v, size)))


def _double(x: Column) -> Column:
    return x["h"].cast("double") * 1e54 + x["m"].cast("double") * 1e27 + x["l"].cast("double")


def divided(chunks: Column, divisor: Column) -> Column:
    """floor(n / divisor) of n given as an array of base-10^9 digits, most significant first; divisor > 0."""
    step = dlit(STEP, 10)
    state = lambda r, q: F.struct(r.alias("r"), q.alias("q"))

    def digit(acc: Column, chunk: Column) -> Column:
        grown = carried(acc["r"]["h"] * step, acc["r"]["m"] * step, acc["r"]["l"] * step + chunk)

        def settle(t: Column) -> Column:
            trial = F.floor(_double(t) / _double(divisor)).cast(D38)

            def correct(s: Column) -> Column:
                low, high = is_negative(s["rest"]), s["rest"] >= divisor
                rest = F.when(low, total((1, s["rest"]), (1, divisor))).when(high, total((1, s["rest"]), (-1, divisor))).otherwise(s["rest"])
                d = s["d"] + F.when(low, -1).when(high, 1).otherwise(0)
                q = acc["q"]
                return state(rest, carried(q["h"] * step, q["m"] * step, q["l"] * step + d))

            rest = lambda d: F.struct(carried(*[t[k] - divisor[k] * d for k in "hml"]).alias("rest"), d.alias("d"))
            return let(let(trial, rest), correct)

        return let(grown, settle)

    zero = constant(0)
    return F.aggregate(chunks, state(zero, zero), digit, lambda acc: acc["q"])


def ray_div(a, i) -> Column:
    """floor((a * 10^27 + floor(i / 2)) / i) of normalised non-negative limbs.

    Null where the index is zero or the numerator leaves 256 bits (see
    :func:`ray_div_fault`).
    """
    a, i = _c(a), _c(i)

    def run(args: Column) -> Column:
        a, i = args["a"], args["i"]
        half = let(i, lambda v: F.struct(*[((v[k] - F.pmod(v[k], dlit(2))) * F.lit("0.5").cast("decimal(2,1)")).cast(D38).alias(k) for k in "hml"],
                                         *[F.pmod(v[k], dlit(2)).alias(f"odd_{k}") for k in "hm"]))
        # half of a limb that is odd moves 10^27 / 2 into the next one
        place = dlit(BASE // 2)
        half = let(half, lambda v: carried(v["h"], v["m"] + v["odd_h"] * place, v["l"] + v["odd_m"] * place))

        def quotient(h: Column) -> Column:
            # a * 10^27 + half, as limbs (a.h, a.m, a.l, 0) + (0, h, m, l), each cut into three base-10^9 digits
            def digits(top: Column) -> Column:
                parts = [top["h"], top["m"], top["l"], h["l"]]
                cut = []
                for p in parts:
                    cut += [F.call_function("div", p, dlit(STEP ** 2)), F.call_function("div", F.pmod(p, dlit(STEP ** 2)), dlit(STEP)), F.pmod(p, dlit(STEP))]
                return F.array(*[c.cast(D38) for c in cut])

            return divided(let(carried(a["h"], a["m"] + h["h"], a["l"] + h["m"]), digits), i)

        return let(half, quotient)

    return let(F.struct(a.alias("a"), i.alias("i")), lambda v: F.when(ray_div_fault(v["a"], v["i"]).isNull(), run(v)))


def ray_div_fault(a, i) -> Column:
    """Why an amount has no quotient: ``zero_index`` or ``overflow`` (a * 10^27 beyond 256 bits), else null."""
    a, i = _c(a), _c(i)
    return F.when(is_zero(i), "zero_index").when(a > constant(MAX // 10 ** 27), "overflow")
