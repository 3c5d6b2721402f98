"""Scalar expressions: ray maths, hex words, guard, addresses, text."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyray.functions.address import normalize_address
from tallyray.functions.keccak import checksum, keccak256, topic0
from tallyray.functions.raymath import burn_delta, mint_delta, ray_div
from tallyray.functions.text import is_provider_error, is_retryable
from tallyray.functions.topics import EVENTS, TOPIC
from tallyray.functions.words import (config_bit, uint_to_word, wide_uint_text, word_to_address,
                                      word_to_bool, word_to_long, word_to_uint)
from tallyray.operators.order import guard_newer, ord_block, ord_log, ordkey

D = T.DecimalType(38, 0)


def py_ray_div(a, i):
    return (a * 10 ** 27 + i // 2) // i


def test_ray_div_matches_integers(spark):
    rnd = random.Random(7)
    cases = []
    for _ in range(400):
        i = rnd.randint(10 ** 26, 10 ** 29 - 1)
        a = rnd.randint(0, min(10 ** 30, i * 10 ** 10))
        cases.append((str(a), str(i)))
    cases += [("0", "1000000000000000000000000000"), ("1", "3"), ("5", "2")]
    df = spark.createDataFrame(cases, "a string, i string").select(
        "a", "i", ray_div(F.col("a").cast(D), F.col("i").cast(D)).cast("string").alias("q"))
    for r in df.collect():
        assert int(r.q) == py_ray_div(int(r.a), int(r.i)), (r.a, r.i)


def test_mint_and_burn_delta(spark):
    idx = 10 ** 27 + 3 * 10 ** 21
    df = spark.createDataFrame([(100, 30), (30, 100), (50, 50)], "v long, b long").select(
        mint_delta(F.col("v"), F.col("b"), F.lit(str(idx)).cast(D)).cast("string").alias("m"),
        burn_delta(F.col("v"), F.col("b"), F.lit(str(idx)).cast(D)).cast("string").alias("u"),
        "v", "b")
    for r in df.collect():
        exp = py_ray_div(r.v - r.b, idx) if r.v >= r.b else -py_ray_div(r.b - r.v, idx)
        assert int(r.m) == exp
        assert int(r.u) == py_ray_div(r.v + r.b, idx)


def test_ray_div_out_of_domain_is_null(spark):
    df = spark.createDataFrame([("5", "0")], "a string, i string")
    assert df.select(ray_div(F.col("a").cast(D), F.col("i").cast(D))).first()[0] is None


def test_words_round_trip(spark):
    rnd = random.Random(3)
    vals = [0, 1, 2 ** 64 - 1, 2 ** 64, 10 ** 27 + 5, 2 ** 125] + [rnd.randint(0, 2 ** 120) for _ in range(50)]
    df = spark.createDataFrame([(str(v),) for v in vals], "v string").select(
        "v", uint_to_word(F.col("v").cast(D)).alias("w"))
    out = df.select("v", "w", word_to_uint("w").cast("string").alias("back")).collect()
    for r in out:
        assert r.w == f"{int(r.v):064x}"
        assert int(r.back) == int(r.v)


def test_wide_words_take_the_exact_path(spark):
    big = 2 ** 256 - 1
    df = spark.createDataFrame([(f"{big:064x}",)], "w string")
    r = df.select(word_to_uint("w").alias("fast"), wide_uint_text("w").alias("wide")).first()
    assert r.fast is None and int(r.wide) == big


def test_word_types(spark):
    addr = "ab" * 20
    df = spark.createDataFrame([("0" * 24 + addr, "0" * 63 + "1", "0" * 63 + "2", f"{2 ** 63:064x}")],
                               "a string, t string, bad string, big string")
    r = df.select(word_to_address("a").alias("a"), word_to_bool("t").alias("t"),
                  word_to_bool("bad").alias("bad"), word_to_long("big").alias("big")).first()
    assert r.a == "0x" + addr and r.t is True and r.bad is None and r.big is None


def test_config_bit(spark):
    word = f"{(1 << 60) | 0x1b58:064x}"
    df = spark.createDataFrame([(word,), (f"{0x1b58:064x}",)], "w string")
    assert [r[0] for r in df.select(config_bit(F.col("w"), 60)).collect()] == [True, False]


# the eight ordering cases: stored (block, log) vs incoming (block, log)
GUARD_CASES = [
    ((100, 5), (99, 10), False), ((100, 5), (100, 3), False), ((100, 5), (100, 5), False),
    ((100, 5), (101, 1), True), ((100, 5), (100, 10), True), ((100, 5), (101, 0), True),
    ((100, 5), (100, 6), True), ((100, 0), (100, 0), False),
]


@pytest.mark.parametrize("stored,incoming,applied", GUARD_CASES)
def test_guard_truth_table(spark, stored, incoming, applied):
    df = spark.createDataFrame([(*stored, *incoming)], "sb long, sl long, b long, l long")
    assert df.select(guard_newer("sb", "sl", "b", "l")).first()[0] is applied


def test_ordkey_packs_and_unpacks(spark):
    df = spark.createDataFrame([(17, -1), (17, 0), (123456789, 99999)], "b long, l long")
    out = df.select("b", "l", ordkey("b", "l").alias("k")).select(
        "b", "l", ord_block("k").alias("b2"), ord_log("k").alias("l2"), "k").collect()
    assert all(r.b == r.b2 and r.l == r.l2 for r in out)
    assert out[0].k < out[1].k


def test_keccak_and_topics():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert topic0("Transfer(address,address,uint256)") == \
        "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert len(EVENTS) == 29 and len(set(TOPIC.values())) == 29
    assert checksum("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed") == \
        "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"


def test_normalize_address_and_text(spark):
    df = spark.createDataFrame([("  0xABCDEF0000000000000000000000000000000001 ",), ("0x12",),
                                ("Request TIMEOUT after 30s",), ("HTTP 429 Too Many Requests",)],
                               "x string")
    out = df.select(normalize_address("x").alias("a"), is_retryable("x").alias("r"),
                    is_provider_error("x").alias("p")).collect()
    assert out[0].a == "0xabcdef0000000000000000000000000000000001" and out[1].a is None
    assert out[2].r and out[2].p and out[3].r and out[3].p
