"""Wide amounts against Python integers."""

import random

import pytest
from pyspark.sql import functions as F

from tallyray.functions import uint256 as u


def numbers():
    rng = random.Random(4)
    fixed = [0, 1, 2, 10 ** 27 - 1, 10 ** 27, 10 ** 54 - 1, 10 ** 54, 2 ** 128, 2 ** 255, u.MAX, u.MAX // 10 ** 27, 10 ** 38 - 1, 10 ** 38]
    return fixed + [rng.randrange(2 ** rng.randrange(1, 257)) for _ in range(60)]


def test_words_and_text(spark):
    ns = numbers()
    df = spark.createDataFrame([(f"{n:064x}", str(n), f"-{n}") for n in ns], "w string, t string, neg string")
    rows = df.select(u.text(u.of_word("w")).alias("a"), u.text(u.of_text("t")).alias("b"), u.text(u.of_text("neg")).alias("c"),
                     u.decimal(u.of_word("w")).alias("d"), u.text(u.of_decimal(u.decimal(u.of_text("neg")))).alias("e")).collect()
    for n, r in zip(ns, rows):
        assert (r.a, r.b, r.c) == (str(n), str(n), str(-n))
        assert r.d == (n if n < 10 ** 38 else None)
        assert r.e == (str(-n) if n < 10 ** 38 else None)
    odd = spark.createDataFrame([("",), ("12x",), ("1" * 82,), ("0" * 90 + "7",), ("xyz",), (None,)], "t string")
    got = odd.select(u.text(u.of_text("t")).alias("t"), u.of_word("t").alias("w")).collect()
    assert [r.t for r in got] == [None, None, None, "7", None, None] and not any(r.w for r in got)


def test_sums_per_limb(spark):
    rng = random.Random(5)
    ns = [rng.choice([-1, 1]) * n for n in numbers() * 3]
    df = spark.createDataFrame([(i % 3, i, str(n)) for i, n in enumerate(ns)], "g int, i int, t string").withColumn("x", u.of_text("t"))
    sums = df.groupBy("g").agg(*[F.sum(f"x.{k}").alias(k) for k in "hml"])
    got = {r.g: r.t for r in sums.select("g", u.text(u.carried(F.col("h"), F.col("m"), F.col("l"))).alias("t")).collect()}
    assert got == {g: str(sum(ns[g::3])) for g in range(3)}
    pair = spark.createDataFrame([(str(a), str(b)) for a, b in zip(ns, ns[1:])], "a string, b string")
    diff = pair.select(u.text(u.total((1, u.of_text("a")), (-1, u.of_text("b")))).alias("d"),
                       u.text(u.magnitude(u.of_text("a"))).alias("m"), u.is_negative(u.of_text("a")).alias("n")).collect()
    assert [(int(r.d), int(r.m), r.n) for r in diff] == [(a - b, abs(a), a < 0) for a, b in zip(ns, ns[1:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_ray_div(spark, seed):
    rng = random.Random(seed)
    indexes = [1, 2, 3, 10 ** 27, 10 ** 27 + 1, 2 * 10 ** 27 - 1, u.MAX] + [rng.randrange(1, 2 ** rng.randrange(1, 257)) for _ in range(40)]
    pairs = [(rng.randrange(2 ** rng.randrange(1, 167)), i) for i in indexes for _ in range(4)]
    pairs += [(u.MAX // 10 ** 27, 1), (u.MAX // 10 ** 27 + 1, 1), (u.MAX, u.MAX), (5, 0), (u.MAX, 0)]
    df = spark.createDataFrame([(str(a), str(i)) for a, i in pairs], "a string, i string")
    a, i = u.of_text("a"), u.of_text("i")
    rows = df.select(u.text(u.ray_div(a, i)).alias("q"), u.ray_div_fault(a, i).alias("fault")).collect()
    for (a, i), r in zip(pairs, rows):
        fault = "zero_index" if i == 0 else "overflow" if a * 10 ** 27 > u.MAX else None
        assert r.fault == fault
        assert r.q == (None if fault else str((a * 10 ** 27 + i // 2) // i)), (a, i)
