"""Bitmaps as of a block against a replay of the flags."""

import random

import pytest

from tallyray.operators.folds import BITMAPS, bitmaps_as_of, fold_bitmaps

KINDS = list(BITMAPS.values())


def flags_and_reserves(spark, seed, n=400):
    rnd = random.Random(seed)
    ids = [0, 1, 31, 32, 63, 64, 95, 96, 127]
    rows = [(rnd.randint(0, 2), f"a{rnd.choice(ids + [500])}", rnd.choice(KINDS), rnd.random() < 0.5, rnd.randint(1, 60), i)
            for i in range(n)]
    rnd.shuffle(rows)
    flags = spark.createDataFrame(rows, "category_id int, asset string, bitmap string, flag boolean, block_number long, log_index long")
    # a500 is a reserve beyond the 128 bits
    reserves = spark.createDataFrame([(f"a{i}", i) for i in ids + [500]], "asset_address string, reserve_id int")
    return rows, flags, reserves


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_bitmaps_as_of_equal_a_replay(spark, bucket):
    rows, flags, reserves = flags_and_reserves(spark, bucket)
    probes = [(c, b, i) for i, (c, b) in enumerate((c, b) for c in range(4) for b in (0, 1, 2, 13, 14, 35, 60, 99))]
    pdf = spark.createDataFrame(probes, "category_id int, block_number long, probe int")
    got = {r.probe: r for r in bitmaps_as_of(pdf, flags, reserves, bucket_blocks=bucket).collect()}
    assert len(got) == len(probes)
    for cat, block, probe in probes:
        bits = dict.fromkeys(KINDS, 0)
        for c, asset, kind, flag, _, _ in sorted((r for r in rows if r[4] <= block), key=lambda r: (r[4], r[5])):
            i = int(asset[1:])
            if c == cat and i < 128:
                bits[kind] = bits[kind] | 1 << i if flag else bits[kind] & ~(1 << i)
        for kind, v in bits.items():
            assert got[probe][f"{kind}_bitmap"] == f"0x{v:032x}", (cat, block, kind)
            assert got[probe][f"{kind}_members"] == v.bit_count()


def test_bitmaps_at_the_end_equal_the_fold(spark):
    _, flags, reserves = flags_and_reserves(spark, 5)
    probes = spark.createDataFrame([(c, 1000) for c in range(3)], "category_id int, block_number long")
    last = {tuple(r) for r in bitmaps_as_of(probes, flags, reserves, 9).drop("block_number").collect()}
    assert last == {tuple(r) for r in fold_bitmaps(flags, reserves).collect()}


def test_no_flags_give_empty_bitmaps(spark):
    _, flags, reserves = flags_and_reserves(spark, 6)
    probes = spark.createDataFrame([(1, 10)], "category_id int, block_number long")
    r = bitmaps_as_of(probes, flags.limit(0), reserves).first()
    assert r.collateral_bitmap == "0x" + "0" * 32 and r.ltvzero_members == 0
    assert bitmaps_as_of(probes.limit(0), flags, reserves).count() == 0
