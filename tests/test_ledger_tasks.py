"""The ledger's sorts hold a bounded number of rows and its events are not shuffled by emitter."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from model import random_legs, random_seed_rows
from tallyray.functions.address import address_of
from tallyray.functions.raymath import RAY, ray_div, with_ray_div
from tallyray.operators import dedup, joins
from tallyray.operators import positions as pos
from tallyray.plans import stages
from tallyray.plans.catalog import QUERIES
from tallyray.session import tasks_for
from test_ledger import legs_df, seed_df
from test_ledger_by_pair import initial_plan


def test_rows_per_task_are_bounded():
    assert tasks_for(0) == tasks_for(50_000) == 1 and tasks_for(600_000) == 12
    for rows in (5_000_000, 36_000_000, 216_000_000, 10 ** 10):
        assert rows / tasks_for(rows) <= 1_250_000 and tasks_for(rows) >= 100
    assert tasks_for(216_000_000) == 200


def copies(spark):
    rows = [(f"0x{i % 97:064x}" if i % 11 else None, i % 3 if i % 7 else None, (i * 31) % 400, f"v{i % 5}") for i in range(400)]
    return spark.createDataFrame(rows, "tx_hash string, log_index long, arrival long, value string")


def test_deliveries_are_sorted_once_behind_their_shuffle(spark):
    df, keys = copies(spark), ["tx_hash", "log_index"]
    tasks = dedup.delivery_tasks(df, keys)
    got = dedup.first_delivery(df, keys, order="arrival", tasks=tasks)
    plan = initial_plan(got)
    assert plan.count(" Sort [") == 1 and plan.index(" Sort [") < plan.index("Exchange")
    assert sorted(map(str, got.collect())) == sorted(map(str, dedup.first_delivery(df, keys, order="arrival").collect()))
    assert initial_plan(stages.delivered_token_events(spark, SF_SMALL)).count(" Sort [") == 1


def test_a_key_with_many_copies_is_reduced_where_it_is_read(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_COPIES", 3)
    assert dedup.delivery_tasks(copies(spark)) is None
    assert dedup.delivery_tasks(copies(spark).dropDuplicates(["tx_hash", "log_index"])) == 1
    assert dedup.delivery_tasks(copies(spark).limit(0)) == 1


def test_many_reserves_with_few_emitters_make_a_small_token_map(spark):
    n = F.col("id")
    reserves = spark.range(110_000).select(address_of(n).alias("asset_address"), address_of(n * 2 + 10 ** 9).alias("atoken_address"),
                                           address_of(n * 2 + 10 ** 9 + 1).alias("v_debt_token_address"))
    events = spark.range(500).select(F.when(n % 50 > 0, address_of(F.lit(10 ** 9) + n % 40)).alias("address"))
    every, used = joins.token_map(reserves), joins.token_map(reserves, joins.emitters(events))
    assert not joins.fits_broadcast(every) and joins.fits_broadcast(used) and used.count() == 40
    assert sorted(map(str, used.collect())) == sorted(map(str, every.join(events, F.col("token") == F.col("address"), "left_semi").collect()))


def test_ray_division_by_steps(spark):
    amounts = [None, "-5", "0", "1", "2", "7", str(10 ** 11), str(RAY), str(RAY + 1), str(10 ** 36 + 3), "9" * 37]
    indexes = [None, "-1", "0", "1", "2", "3", str(10 ** 18 + 1), str(RAY), str(RAY + 10 ** 21), str(10 ** 29 - 1), str(10 ** 29)]
    df = spark.createDataFrame([(a, i) for a in amounts for i in indexes], "a string, i string") \
        .select(F.col("a").cast("decimal(38,0)").alias("a"), F.col("i").cast("decimal(38,0)").alias("i"))
    got = with_ray_div(df.withColumn("whole", ray_div("a", "i")), F.col("a"), F.col("i"), "steps")
    assert got.columns == ["a", "i", "whole", "steps"]
    rows = got.collect()
    assert all(r.whole == r.steps for r in rows) and sum(r.steps is not None for r in rows) > 40
    for r in rows:
        assert r.steps is None or int(r.steps) == (int(r.a) * RAY + int(r.i) // 2) // int(r.i)


def test_pairs_are_sorted_in_tasks_by_their_legs(spark, monkeypatch):
    monkeypatch.setattr(pos, "tasks_for", lambda legs: 37)
    legs = random_legs(61)
    plan = initial_plan(pos.fold_positions(legs_df(spark, legs)))
    assert plan.count("Exchange") == 1 and "37), REPARTITION_BY_NUM" in plan
    # seed rows come to the legs, which are not shuffled again
    plan = initial_plan(pos.fold_positions(legs_df(spark, legs), seed=seed_df(spark, random_seed_rows(61, 30)), stale_before=(30, -1)))
    legs_side = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in legs_side) == 1 and len(legs_side) <= 3


def test_positions_for_an_insert_are_folded_once(spark):
    plan = initial_plan(QUERIES["insert_if_absent_positions"](spark, SF_SMALL))
    assert "creation" not in plan and plan.count("Location: ") >= 2


def test_seed_rows_are_neither_broadcast_nor_joined_onto_the_legs(spark, monkeypatch):
    legs, seeds = random_legs(63), random_seed_rows(63, 30)
    fold = lambda rows: pos.fold_positions(legs_df(spark, legs), seed=seed_df(spark, rows), stale_before=(30, -1))
    plan = initial_plan(fold(seeds))
    assert "Broadcast" not in plan and plan.count("Join") == 1
    once = sorted(map(str, fold(seeds).collect()))
    monkeypatch.setattr(pos, "HOT_LEGS", 3)
    assert "BroadcastHashJoin" not in "".join(x for x in initial_plan(fold(seeds)).splitlines(True) if "LeftOuter" in x)
    assert sorted(map(str, fold(seeds).collect())) == once


def test_hashes_of_keys_are_not_shuffled(spark):
    shuffled = lambda df: [x for x in initial_plan(df).splitlines() if "REPARTITION_BY_NUM" in x]
    for df in (dedup.first_delivery(copies(spark), ["tx_hash", "log_index"], order="arrival", tasks=5),
               pos.fold_positions(legs_df(spark, random_legs(64)))):
        assert len(shuffled(df)) == 1 and "hash#" not in shuffled(df)[0].replace("tx_hash#", "") and "ph#" not in shuffled(df)[0]
