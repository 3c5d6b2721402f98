"""The ledger by pair (one shuffle of the legs) and, for hot pairs, by block bucket."""

import pytest
from pyspark.sql import functions as F

from model import model_fold, random_legs, random_seed_rows
from tallyray.operators import positions as pos
from tallyray.operators.dedup import first_delivery
from test_ledger import as_model, legs_df, seed_df


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fold_shuffles_its_legs_once(spark):
    assert initial_plan(pos.fold_positions(legs_df(spark, random_legs(51)))).count("Exchange") == 1
    assert initial_plan(pos.leg_effects(legs_df(spark, random_legs(51)))).count("Exchange") == 1


@pytest.mark.parametrize("hot", [-1, 12])
def test_hot_pairs_by_bucket(spark, monkeypatch, hot):
    monkeypatch.setattr(pos, "HOT_LEGS", hot)
    at, legs, rows = 30, random_legs(52), random_seed_rows(52, 30)
    sizes = {}
    for leg in legs:
        pair = leg["user_address"], leg["asset_address"]
        sizes[pair] = sizes.get(pair, 0) + 1
    assert hot < 0 or min(sizes.values()) <= hot < max(sizes.values())
    assert as_model(pos.fold_positions(legs_df(spark, legs), bucket_blocks=7)) == model_fold(legs)
    got = pos.fold_positions(legs_df(spark, legs), seed=seed_df(spark, rows), stale_before=(at, -1), bucket_blocks=9)
    assert as_model(got) == model_fold(legs, rows)


def test_both_forms_agree_on_nulls(spark, monkeypatch):
    gone = lambda c, k: F.when(F.pmod(F.xxhash64("block_number", "log_index", "leg", F.lit(k)), F.lit(9)) != 0, F.col(c)).alias(c)
    odd = {"user_address": 1, "asset_address": 2, "block_number": 3, "log_index": 4}
    legs = legs_df(spark, random_legs(53)).repartition(1).localCheckpoint()
    legs = legs.select(*[gone(c, odd[c]) if c in odd else c for c in legs.columns]).localCheckpoint()
    history = ["user_address", "asset_address", "ok", "run_s", "run_d", "coll_ev", "act_ev", "sidx_ev", "didx_ev"]

    def both():
        runs = pos.leg_effects(legs, bucket_blocks=9).where("kept").select(history)
        return [sorted(map(str, d.collect())) for d in (pos.fold_positions(legs, bucket_blocks=9), runs)]

    by_pair = both()
    monkeypatch.setattr(pos, "HOT_LEGS", -1)
    assert by_pair == both() and all(by_pair)


def test_repeated_seed_rows_go_by_bucket(spark, monkeypatch):
    legs, rows = random_legs(54), random_seed_rows(54, 30)
    seed = seed_df(spark, rows)
    seed = seed.union(seed.orderBy("user_address", "asset_address").limit(1))
    fold = lambda: sorted(map(str, pos.fold_positions(legs_df(spark, legs), seed=seed, stale_before=(30, -1)).collect()))
    got = fold()
    monkeypatch.setattr(pos, "HOT_LEGS", -1)
    assert got == fold()


def test_copies_are_sorted_by_a_number_first(spark):
    rows = [("0x" + "0" * 60 + f"{i % 7:04d}", i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "tx_hash string, log_index long, arrival long")
    got = first_delivery(df, order="arrival")
    first = {}
    for t, k, a in rows:
        first[t, k] = min(a, first.get((t, k), a))
    assert {(r.tx_hash, r.log_index): r.arrival for r in got.collect()} == first and got.columns == df.columns
    sort = next(s for s in initial_plan(got).splitlines() if " Sort [" in s)
    assert sort.split(" Sort [")[1].startswith("__hash")
