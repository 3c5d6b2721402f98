"""The ledger fold over amounts beyond 38 digits vs the sequential model."""

import pytest
from pyspark.sql import functions as F

from model import ASSETS, model_fold, random_legs, random_seed_rows
from tallyray.functions import uint256 as u
from tallyray.operators.positions import exact_texts, fold_positions, kept_legs, ledger_rejects, position_legs
from test_ledger import legs_df, seed_df

BIG = 2 ** 170 + 1
AMOUNTS = ("d_supply", "d_debt", "s_index", "d_index")


def widened(spark, legs):
    """Legs of the first asset times BIG, in the limb column; the others narrow."""
    texts = spark.createDataFrame(
        [(l["user_address"], l["asset_address"], l["block_number"], l["log_index"], l["leg"],
          *[None if l[c] is None or l["asset_address"] != ASSETS[0] else str(l[c]) for c in AMOUNTS]) for l in legs],
        "user_address string, asset_address string, block_number long, log_index long, leg int, "
        + ", ".join(f"x_{c} string" for c in AMOUNTS))
    first = F.col("asset_address") == ASSETS[0]
    narrow = legs_df(spark, [{**l, **({c: 0 for c in AMOUNTS[:2]} if l["asset_address"] == ASSETS[0] else {})} for l in legs])
    j = narrow.join(texts, ["user_address", "asset_address", "block_number", "log_index", "leg"])
    wide = F.struct(*[u.of_text(f"x_{c}").alias(c) for c in AMOUNTS])
    return j.withColumn("wide", F.when(first, wide)).drop(*[f"x_{c}" for c in AMOUNTS])


def as_model(df):
    return {(r.user_address, r.asset_address): {
        "s": int(r.scaled_atoken_balance), "d": int(r.scaled_variable_debt), "coll": r.use_as_collateral,
        "active": r.is_active, "sidx": int(r.atoken_last_index), "didx": int(r.debt_last_index),
        "lb": r.last_updated_block, "ll": r.last_updated_log_index, "created": r.created_at_block}
        for r in exact_texts(df).collect()}


def grow(legs):
    return [{**l, "d_supply": l["d_supply"] * BIG, "d_debt": l["d_debt"] * BIG} if l["asset_address"] == ASSETS[0] else l for l in legs]


@pytest.mark.parametrize("bucket", [7, 1000])
def test_wide_pairs(spark, bucket):
    legs = grow(random_legs(41, n_events=90, max_block=40))
    assert as_model(fold_positions(widened(spark, legs), bucket_blocks=bucket)) == model_fold(legs)


def test_wide_pairs_on_seed_rows(spark):
    at = 20
    legs = grow(random_legs(42, n_events=90, max_block=40))
    rows = random_seed_rows(42, at)
    big = {k: {**r, "s": r["s"] * BIG, "d": r["d"] * BIG} if k[1] == ASSETS[0] else r for k, r in rows.items()}
    seed = exact_texts(seed_df(spark, rows))
    for c in ("scaled_atoken_balance", "scaled_variable_debt"):  # texts of any size
        grown = F.create_map(*[F.lit(x) for r in rows.values() for k in "sd" for x in (str(r[k]), str(r[k] * BIG))])
        seed = seed.withColumn(c, F.when(F.col("asset_address") == ASSETS[0], grown[F.col(c)]).otherwise(F.col(c)))
    got = as_model(fold_positions(widened(spark, legs), seed=seed, stale_before=(at, -1), bucket_blocks=9))
    assert got == model_fold(legs, big)


def test_every_amount_is_a_leg_or_a_reject(spark):
    ray = 10 ** 27
    cases = [("Mint", 5, 2, ray, None), ("Mint", 2, 5, ray, None), ("Burn", 5, 2, ray, None), ("Mint", u.MAX, 0, ray, "overflow"),
             ("Mint", u.MAX, u.MAX - 7, ray, None), ("Burn", u.MAX // ray, 0, 3, None), ("Burn", 7, 0, 0, "zero_index"),
             ("Mint", 10 ** 45, 10 ** 44, 2 * ray, None), ("BalanceTransfer", u.MAX, None, 0, None), ("Mint", 10 ** 37, 1, u.MAX, None)]
    rows = [(i, e, str(v), None if b is None else str(b), str(x)) for i, (e, v, b, x, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "log_index long, event string, v string, b string, x string")
    amounts = {"value": "v", "balance_increase": "b", "idx": "x"}
    fits = lambda c: F.when(F.length(c) < 38, F.col(c).try_cast("decimal(38,0)"))
    exact = F.struct(*[u.of_text(c).alias(n) for n, c in amounts.items()])
    some = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in amounts.values()]) >= 38
    df = df.select("log_index", "event", *[fits(c).alias(n) for n, c in amounts.items()], F.when(some, exact).alias("exact"),
                   F.lit("f").alias("from_address"), F.lit("t").alias("to_address"), F.lit("a").alias("asset_address"),
                   F.lit("atoken").alias("token_type"), F.lit(1).cast("long").alias("block_number"), F.lit("h").alias("tx_hash"))
    legs = position_legs(df).cache()
    assert {r.log_index: r.reason for r in ledger_rejects(legs).collect()} == {i: c[4] for i, c in enumerate(cases) if c[4]}
    text = F.coalesce(u.text(F.col("wide")["d_supply"]), F.col("d_supply").cast("string"))
    got = {(r.log_index, r.leg): (int(r.d), r.is_up) for r in kept_legs(legs).select("log_index", "leg", "is_up", text.alias("d")).collect()}
    want = {}
    for i, (e, v, b, x, fault) in enumerate(cases):
        if fault:
            continue
        if e == "BalanceTransfer":
            want[i, 0], want[i, 1] = (-v, False), (v, True)
        else:
            a = v + b if e == "Burn" else abs(v - b)
            q = (a * ray + x // 2) // x
            want[i, 0] = (-q if e == "Burn" or v < b else q, e == "Mint" and v >= b)
    assert got == want
