"""Set-based ledger fold vs the sequential model, on random legs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from model import model_fold, random_legs, random_seed_rows
from tallyray.operators.positions import exact_texts, fold_positions, leg_effects, states_at

D = T.DecimalType(38, 0)
LEG_SCHEMA = T.StructType([
    T.StructField("user_address", T.StringType()), T.StructField("asset_address", T.StringType()),
    T.StructField("block_number", T.LongType()), T.StructField("log_index", T.LongType()),
    T.StructField("tx_hash", T.StringType()), T.StructField("leg", T.IntegerType()),
    T.StructField("d_supply", T.StringType()), T.StructField("d_debt", T.StringType()),
    T.StructField("s_index", T.StringType()), T.StructField("d_index", T.StringType()),
    T.StructField("is_up", T.BooleanType()), T.StructField("clear", T.StringType()),
    T.StructField("toggle", T.BooleanType()), T.StructField("is_self", T.BooleanType()),
])


def legs_df(spark, legs):
    rows = [(l["user_address"], l["asset_address"], l["block_number"], l["log_index"], l["tx_hash"],
             l["leg"], str(l["d_supply"]), str(l["d_debt"]),
             None if l["s_index"] is None else str(l["s_index"]),
             None if l["d_index"] is None else str(l["d_index"]),
             l["is_up"], l["clear"], l["toggle"], l["is_self"]) for l in legs]
    df = spark.createDataFrame(rows, LEG_SCHEMA)
    for c in ["d_supply", "d_debt", "s_index", "d_index"]:
        df = df.withColumn(c, F.col(c).cast(D))
    return df


def seed_df(spark, rows):
    data = [(u, a, str(r["s"]), str(r["d"]), r["coll"], str(r["sidx"]), str(r["didx"]), r["lb"],
             r["ll"], r["active"], r["created"]) for (u, a), r in rows.items()]
    df = spark.createDataFrame(data, "user_address string, asset_address string, s string, d string, "
                               "use_as_collateral boolean, si string, di string, last_updated_block long, "
                               "last_updated_log_index long, is_active boolean, created_at_block long")
    return df.select("user_address", "asset_address", F.col("s").cast(D).alias("scaled_atoken_balance"),
                     F.col("d").cast(D).alias("scaled_variable_debt"), "use_as_collateral",
                     F.col("si").cast(D).alias("atoken_last_index"),
                     F.col("di").cast(D).alias("debt_last_index"), "last_updated_block",
                     "last_updated_log_index", "is_active", "created_at_block")


def as_model(df):
    out = {}
    for r in df.collect():
        out[(r.user_address, r.asset_address)] = {
            "s": int(r.scaled_atoken_balance), "d": int(r.scaled_variable_debt),
            "coll": r.use_as_collateral, "active": r.is_active, "sidx": int(r.atoken_last_index),
            "didx": int(r.debt_last_index), "lb": r.last_updated_block, "ll": r.last_updated_log_index,
            "created": r.created_at_block}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("bucket", [7, 1000])
def test_fold_matches_sequential_model(spark, seed, bucket):
    legs = random_legs(seed)
    got = as_model(fold_positions(legs_df(spark, legs), bucket_blocks=bucket))
    assert got == model_fold(legs)


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_seeded_fold_with_stale_legs(spark, seed):
    at = 30
    legs = random_legs(seed)
    rows = random_seed_rows(seed, at)
    got = as_model(fold_positions(legs_df(spark, legs), seed=seed_df(spark, rows),
                                  stale_before=(at, -1), bucket_blocks=9))
    assert got == model_fold(legs, rows)


def test_input_order_and_duplicates_do_not_matter(spark):
    legs = random_legs(11)
    df = legs_df(spark, legs)
    shuffled = df.repartition(5).orderBy(F.rand(3))
    a = as_model(fold_positions(df))
    b = as_model(fold_positions(shuffled))
    assert a == b


def test_prefix_then_suffix_equals_whole(spark):
    legs = random_legs(12, max_block=80)
    whole = as_model(fold_positions(legs_df(spark, legs)))
    pre = [l for l in legs if l["block_number"] < 40]
    suf = [l for l in legs if l["block_number"] >= 40]
    seed = fold_positions(legs_df(spark, pre))
    inc = as_model(fold_positions(legs_df(spark, suf), seed=seed))
    assert inc == whole


def test_running_balance_history(spark):
    legs = random_legs(13)
    fx = leg_effects(legs_df(spark, legs), bucket_blocks=5).where("kept")
    # the last kept leg of every pair carries the final balances
    last = fx.groupBy("user_address", "asset_address").agg(
        F.max_by(F.struct("run_s", "run_d"), "ok").alias("r")).collect()
    model = model_fold(legs)
    for r in last:
        st = model[(r.user_address, r.asset_address)]
        assert (int(r.r.run_s), int(r.r.run_d)) == (st["s"], st["d"])


def test_self_transfer_on_existing_row_is_lost(spark):
    u, a = "0x" + "1" * 40, "0x" + "2" * 40
    base = dict(user_address=u, asset_address=a, tx_hash="0x1", d_debt=0, s_index=None,
                d_index=None, clear=None, toggle=None, is_self=False)
    legs = [
        {**base, "block_number": 1, "log_index": 0, "leg": 0, "d_supply": 100, "s_index": 10,
         "is_up": True},
        {**base, "block_number": 2, "log_index": 0, "leg": 0, "d_supply": -30, "is_up": False,
         "clear": "S"},
        {**base, "block_number": 2, "log_index": 0, "leg": 1, "d_supply": 30, "s_index": 11,
         "is_up": True, "is_self": True},
    ]
    got = as_model(fold_positions(legs_df(spark, legs)))
    assert got[(u, a)]["s"] == 70  # the receiving leg fails the guard


def test_burn_all_supply_keeps_debt_active(spark):
    u, a = "0x" + "3" * 40, "0x" + "4" * 40
    base = dict(user_address=u, asset_address=a, tx_hash="0x1", leg=0, s_index=None, d_index=None,
                clear=None, toggle=None, is_self=False)
    legs = [
        {**base, "block_number": 100, "log_index": 0, "d_supply": 1000, "d_debt": 0, "is_up": True},
        {**base, "block_number": 100, "log_index": 1, "d_supply": 0, "d_debt": 500, "is_up": True},
        {**base, "block_number": 100, "log_index": 2, "d_supply": 0, "d_debt": 0, "is_up": False,
         "toggle": True},
        {**base, "block_number": 101, "log_index": 0, "d_supply": -1000, "d_debt": 0, "is_up": False,
         "clear": "S"},
    ]
    st = as_model(fold_positions(legs_df(spark, legs)))[(u, a)]
    assert st["coll"] is False and st["active"] is True and st["s"] == 0 and st["d"] == 500
    legs.append({**base, "block_number": 102, "log_index": 0, "d_supply": 0, "d_debt": -500,
                 "is_up": False, "clear": "D"})
    st = as_model(fold_positions(legs_df(spark, legs)))[(u, a)]
    assert st["active"] is False and st["coll"] is False


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_seeded_fold_with_per_row_cutoffs(spark, seed):
    import random
    rnd = random.Random(seed)
    legs = random_legs(seed)
    rows = random_seed_rows(seed, 0)
    for r in rows.values():  # every seed row has its own last update
        r["lb"], r["ll"] = rnd.randint(0, 59), rnd.randint(-1, 5)
    got = as_model(fold_positions(legs_df(spark, legs), seed=seed_df(spark, rows),
                                  stale_before="row", bucket_blocks=7))
    assert got == model_fold(legs, rows)


def test_hot_pair_is_spread_over_buckets(spark):
    """One (user, asset) owning almost all legs is split by block bucket before
    the ledger window, so it does not land in a single task."""
    from tallyray.operators.positions import _legs_with_running
    hot = [dict(user_address="0x" + "a" * 40, asset_address="0x" + "b" * 40, block_number=b,
                log_index=0, tx_hash="0x1", leg=0, d_supply=1, d_debt=0, s_index=1, d_index=None,
                is_up=True, clear=None, toggle=None, is_self=False) for b in range(2000)]
    cold = random_legs(31, n_events=50)
    lr = _legs_with_running(legs_df(spark, hot + cold), None, bucket_blocks=50)
    per_part = lr.where(F.col("user_address") == "0x" + "a" * 40) \
        .groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_part) > 1
    plan = lr._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_address" in plan and "bkt" in plan
    # and the fold over the hot pair is still exact
    got = as_model(fold_positions(legs_df(spark, hot + cold), bucket_blocks=50))
    assert got == model_fold(hot + cold)


@pytest.mark.parametrize("seed", [21, 22])
@pytest.mark.parametrize("bucket", [7, 1000])
def test_states_at_many_anchors(spark, seed, bucket):
    legs = random_legs(seed)
    last = max(l["block_number"] for l in legs)
    blocks = [0, 3, 4, last // 3, last // 2, last - 1, last, last + 50]
    anchors = spark.createDataFrame([(b,) for b in blocks + [None, -5, 3]], "anchor long")
    got = states_at(legs_df(spark, legs), anchors, bucket_blocks=bucket).cache()
    assert {r.anchor for r in got.select("anchor").distinct().collect()} <= set(blocks)
    for b in blocks:
        assert as_model(got.where(F.col("anchor") == b)) == model_fold([l for l in legs if l["block_number"] <= b])
    none = spark.createDataFrame([], "anchor long")
    assert states_at(legs_df(spark, legs), none, bucket_blocks=bucket).count() == 0


def test_states_at_with_wide_amounts(spark):
    legs = random_legs(23)
    legs_ = legs_df(spark, legs)
    pair = (F.col("user_address") == legs[0]["user_address"]) & (F.col("asset_address") == legs[0]["asset_address"])
    big = lambda c: F.when(F.col(c).isNull(), None).otherwise(
        F.struct(F.lit(7).cast(D).alias("h"), F.lit(0).cast(D).alias("m"), F.col(c).alias("l")))
    wide = F.struct(big("d_supply").alias("d_supply"), big("d_debt").alias("d_debt"), big("s_index").alias("s_index"), big("d_index").alias("d_index"))
    legs_ = legs_.withColumn("wide", F.when(pair & F.col("is_up"), wide))
    blocks = sorted({l["block_number"] for l in legs})[:: 7]
    got = exact_texts(states_at(legs_, spark.createDataFrame([(b,) for b in blocks], "anchor long"), bucket_blocks=9))
    rows = sorted(map(tuple, got.collect()), key=str)
    want = [(b, *r) for b in blocks for r in map(tuple, exact_texts(fold_positions(legs_.where(F.col("block_number") <= b), bucket_blocks=9)).collect())]
    assert rows == sorted(want, key=str) and any(len(r[3]) > 50 for r in rows)
