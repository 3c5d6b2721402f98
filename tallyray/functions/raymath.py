"""Fixed-point ray maths (27 decimals) as exact decimal expressions, no UDF.

``ray_div(a, i) = floor((a * 10^27 + floor(i / 2)) / i)``.  ``a * 10^27``
overflows 38 digits for realistic amounts, so the quotient is built by long
division in base 10^9: three rounds of ``t = r * 10^9; q = q * 10^9 + t div i;
r = t mod i``, then ``+1`` when ``2r >= i`` (which equals adding ``floor(i/2)``
before flooring).  Every intermediate stays below 10^38 for ``i < 10^29`` and a
quotient below 10^38; :func:`ray_div_in_domain` states the checked domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import dlit

D38 = T.DecimalType(38, 0)
RAY = 10 ** 27
BASE = 10 ** 9


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(D38)


def ray_div_in_domain(a, i) -> Column:
    a, i = _c(a), _c(i)
    return (i > 0) & (i < dlit(10 ** 29)) & (a >= 0) & \
        (a.cast("double") / i.cast("double") < F.lit(1e11))


def ray_div(a, i) -> Column:
    """Exact WadRayMath rayDiv; null outside :func:`ray_div_in_domain`."""
    a, i = _c(a), _c(i)
    base = dlit(BASE, 10)
    # a div i stays below 2^63 inside the domain (a / i < 10^11)
    q = (a - F.pmod(a, i)) / i
    q = q.cast(D38)
    r = F.pmod(a, i)
    for _ in range(3):
        t = (r * base).cast(D38)
        step = ((t - F.pmod(t, i)) / i).cast(D38)
        q = (q * base + step).cast(D38)
        r = F.pmod(t, i)
    res = q + F.when(r * 2 >= i, F.lit(1)).otherwise(F.lit(0)).cast(D38)
    return F.when(ray_div_in_domain(a, i), res.cast(D38))


def with_ray_div(df: DataFrame, a: Column, i: Column, out: str) -> DataFrame:
    """``df`` with ``out`` = :func:`ray_div` of a and i.

    One projection a step, so that each quotient is computed once and its
    remainder comes from a product: as one expression inside a condition every
    step computes all earlier ones again.
    """
    keep = df.columns
    div = lambda x, y: F.call_function("div", x, y)  # noqa: E731  below 2^63 inside the domain
    a, i, t, s, q = _c(a), _c(i), F.col("__t"), F.col("__s"), F.col("__q")
    index = F.col("__i")
    df = df.select("*", F.when(ray_div_in_domain(a, i), a).alias("__t"), F.when(ray_div_in_domain(a, i), i).alias("__i"),
                   dlit(0).alias("__q"))
    for step in range(4):
        df = df.select(*keep, "__t", "__i", "__q", div(t, index).alias("__s"))
        rest = (t - s * index).cast(D38)
        df = df.select(*keep, "__i", (rest * dlit(BASE, 10) if step < 3 else rest * 2).cast(D38).alias("__t"),
                       ((q * dlit(BASE, 10) if step else q) + s).cast(D38).alias("__q"))
    return df.select(*keep, (q + F.when(t >= index, F.lit(1)).otherwise(F.lit(0)).cast(D38)).cast(D38).alias(out))


def mint_delta(value, inc, index) -> Column:
    """Signed scaled delta of a Mint: +rayDiv(value-inc) or -rayDiv(inc-value)."""
    v, b = _c(value), _c(inc)
    return F.when(v >= b, ray_div(v - b, index)).otherwise(-ray_div(b - v, index)).cast(D38)


def burn_delta(value, inc, index) -> Column:
    """Scaled amount removed by a Burn: rayDiv(value + inc) (a magnitude)."""
    return ray_div(_c(value) + _c(inc), index)
