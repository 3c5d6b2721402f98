"""Decoding round trips, rejects, reserve / eMode folds, merges."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyray.operators.decode import RESERVE_FAMILY, TOKEN_FAMILY, decode_logs, decode_rejects
from tallyray.operators.dedup import first_delivery
from tallyray.operators.folds import fold_bitmaps, fold_reserves, merge_overwrite
from tallyray.sources.fixtures import encode_logs

D = T.DecimalType(38, 0)
ASSET = "0x" + "0" * 39 + "a"


def test_token_and_collateral_round_trip(spark):
    rows = [("Mint", "0x" + "1" * 40, "0x" + "2" * 40, "100", "7", str(10 ** 27), None, None),
            ("Burn", "0x" + "3" * 40, "0x" + "3" * 40, "5", "0", str(10 ** 27 + 1), None, None),
            ("BalanceTransfer", "0x" + "4" * 40, "0x" + "5" * 40, "9", None, str(10 ** 28), None, None),
            ("ReserveUsedAsCollateralEnabled", None, None, None, None, None, ASSET, "0x" + "6" * 40)]
    df = spark.createDataFrame(rows, "event string, from_address string, to_address string, value string, "
                               "balance_increase string, idx string, reserve string, user_address string")
    df = df.select("event", "from_address", "to_address", "reserve", "user_address",
                   *[F.col(c).cast(D).alias(c) for c in ["value", "balance_increase", "idx"]],
                   F.lit(1).cast("long").alias("block_number"),
                   F.monotonically_increasing_id().alias("log_index"), F.lit("0x01").alias("tx_hash"))
    raw = encode_logs(df, F.lit("0x" + "9" * 40), TOKEN_FAMILY)
    back = decode_logs(raw, TOKEN_FAMILY).orderBy("log_index").collect()
    assert [r.event for r in back] == ["Mint", "Burn", "BalanceTransfer", "ReserveUsedAsCollateralEnabled"]
    assert int(back[0].value) == 100 and int(back[0].balance_increase) == 7
    assert back[2].balance_increase is None and int(back[2].idx) == 10 ** 28
    assert back[3].reserve == ASSET


def test_category_string_round_trip(spark):
    df = spark.createDataFrame([(3, 9000, 9300, 10100, "0x" + "7" * 40, "Stablecoins ünïcode label that is longer than thirty-two bytes")],
                               "category_id int, ltv long, liquidation_threshold long, "
                               "liquidation_bonus long, oracle string, label string")
    df = df.select("*", F.lit("EModeCategoryAdded").alias("event"), F.lit(5).cast("long").alias("block_number"),
                   F.lit(0).cast("long").alias("log_index"), F.lit("0x02").alias("tx_hash"))
    raw = encode_logs(df, F.lit("0x" + "8" * 40), ["EModeCategoryAdded"])
    r = decode_logs(raw, RESERVE_FAMILY).first()
    assert r.category_id == 3 and r.ltv == 9000 and r.label.startswith("Stablecoins ü")


def test_rejects(spark):
    rows = [("0x" + "1" * 40, [], "0x", 1, 1, "0xa"),
            ("0x" + "1" * 40, ["0x" + "f" * 64], "0x", 1, 2, "0xa"),
            ("0x" + "1" * 40, ["0x458f5fa412d0f69b08dd84872b0215675cc67bc1d5b6fd93300a1c3878b86196"],
             "0x", 1, 3, "0xa")]
    df = spark.createDataFrame(rows, "address string, topics array<string>, data string, "
                               "block_number long, log_index long, tx_hash string")
    got = {r.log_index: r.reason for r in decode_rejects(df).collect()}
    assert got == {1: "no_topics", 2: "unknown_topic", 3: "malformed"}


def _reserves(spark):
    return spark.createDataFrame(
        [(ASSET, False, False, True, False, "0", 0, -1)],
        "asset_address string, is_frozen boolean, is_dropped boolean, is_active boolean, "
        "is_paused boolean, sc string, last_updated_block long, last_updated_log_index long"
    ).select("asset_address", "is_frozen", "is_dropped", "is_active", "is_paused",
             F.col("sc").cast(D).alias("supply_cap"), "last_updated_block", "last_updated_log_index")


def _events(spark, rows):
    return spark.createDataFrame(rows, "event string, block_number long, log_index long, tx_hash string, "
                                 "new_amount string, flag boolean").select(
        "event", "block_number", "log_index", "tx_hash", F.lit(ASSET).alias("asset"),
        F.col("new_amount").cast(D).alias("new_amount"), "flag")


def test_out_of_order_arrival_folds_in_chain_order(spark):
    ev = _events(spark, [("ReserveFrozen", 103, 0, "0x3", None, None),
                         ("ReserveFrozen", 101, 0, "0x1", None, None),
                         ("ReserveUnfrozen", 102, 0, "0x2", None, None)])
    r = fold_reserves(ev, _reserves(spark)).first()
    assert r.is_frozen is True and r.last_updated_block == 103


def test_duplicate_delivery_keeps_first(spark):
    ev = _events(spark, [("SupplyCapChanged", 200, 4, "0xaa", "2000000", None),
                         ("SupplyCapChanged", 200, 4, "0xaa", "5000000", None)])
    ev = ev.withColumn("arrival", F.monotonically_increasing_id())
    first = first_delivery(ev, ("tx_hash", "log_index"), order="arrival").drop("arrival")
    assert int(fold_reserves(first, _reserves(spark)).first().supply_cap) == 2000000


def test_drop_marks_inactive_and_stale_events_are_ignored(spark):
    res = _reserves(spark).withColumn("last_updated_block", F.lit(150).cast("long"))
    ev = _events(spark, [("ReserveDropped", 160, 1, "0x1", None, None),
                         ("ReservePaused", 149, 0, "0x2", None, True)])
    r = fold_reserves(ev, res).first()
    assert r.is_dropped and r.is_active is False and r.is_paused is False


def test_bitmap_latest_flag_wins(spark):
    res = spark.createDataFrame([("0x" + "0" * 39 + "1", 0), ("0x" + "0" * 39 + "2", 1),
                                 ("0x" + "0" * 39 + "3", 2)], "asset_address string, reserve_id int")
    flags = spark.createDataFrame(
        [(1, "0x" + "0" * 39 + "1", "collateral", True, 1, 0), (1, "0x" + "0" * 39 + "2", "collateral", True, 1, 1),
         (1, "0x" + "0" * 39 + "3", "collateral", True, 1, 2), (1, "0x" + "0" * 39 + "2", "collateral", False, 2, 0)],
        "category_id int, asset string, bitmap string, flag boolean, block_number long, log_index long")
    r = fold_bitmaps(flags, res).first()
    assert r.collateral_bitmap.endswith("5") and r.collateral_members == 2  # 7 then 5


def test_merge_overwrite_keeps_existing_ordkey(spark):
    old = spark.createDataFrame([("a", 1, 10, 0)], "asset_address string, v int, last_updated_block long, "
                                "last_updated_log_index long")
    new = spark.createDataFrame([("a", 2, 50, -1), ("b", 3, 50, -1)], "asset_address string, v int, "
                                "last_updated_block long, last_updated_log_index long")
    out = {r.asset_address: r for r in merge_overwrite(old, new).collect()}
    assert out["a"].v == 2 and out["a"].last_updated_block == 10 and out["b"].last_updated_block == 50


def test_token_logs_without_position_are_rejected(spark):
    mint = "0x458f5fa412d0f69b08dd84872b0215675cc67bc1d5b6fd93300a1c3878b86196"
    word = lambda n: f"{n:064x}"
    data = "0x" + word(5) + word(1) + word(10 ** 27)
    topics = [mint, "0x" + word(1), "0x" + word(2)]
    rows = [("0x" + "1" * 40, topics, data, None, 1, "0xa"),
            ("0x" + "1" * 40, topics, data, 5, None, "0xa"),
            ("0x" + "1" * 40, topics, data, 5, 2, None),
            ("0x" + "1" * 40, topics, data, 5, 3, "0xa")]
    df = spark.createDataFrame(rows, "address string, topics array<string>, data string, "
                               "block_number long, log_index long, tx_hash string")
    got = [r.reason for r in decode_rejects(df).collect()]
    assert got == ["missing_position"] * 3
    assert [r.log_index for r in decode_logs(df, TOKEN_FAMILY).collect()] == [3]


def test_cleared_category_keeps_its_row(spark):
    res = spark.createDataFrame([("0xa", 0)], "asset_address string, reserve_id int")
    flags = spark.createDataFrame(
        [(1, "0xa", "collateral", True, 1, 0), (1, "0xa", "collateral", False, 2, 0)],
        "category_id int, asset string, bitmap string, flag boolean, block_number long, log_index long")
    r = fold_bitmaps(flags, res).first()
    assert r.collateral_bitmap == "0x" + "0" * 32 and r.collateral_members == 0


def test_snapshot_numbers_are_exact_or_rejected(spark):
    import json
    from tallyray.sources.snapshot import load_position_snapshot, snapshot_rejects
    asset = "0x" + "a" * 40
    row = lambda k, v, a=asset: {"id": k, "user": {"id": "0x" + "b" * 40}, "reserve": {
        "underlyingAsset": a, "liquidityIndex": "1", "variableBorrowIndex": "1"},
        "usageAsCollateralEnabledOnUser": True, "scaledATokenBalance": v, "scaledVariableDebt": "0"}
    body = json.dumps({"data": {"userReserves": [row("f", "1.5"), row("w", "1" * 40), row("s", "7"), row("t", "10000000000000000000"), row("n", "3", None)]}})
    pages = spark.createDataFrame([(body,)], "body string")
    good = load_position_snapshot(pages, 10).select("scaled_atoken_balance").collect()
    assert sorted(int(r[0]) for r in good) == [7, 10**19]
    res = spark.createDataFrame([(asset,)], "asset_address string")
    assert sorted(map(tuple, snapshot_rejects(pages, res).collect())) == [("f", "unparsable"), ("n", "unparsable"), ("w", "unparsable")]
