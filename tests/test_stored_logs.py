"""Stored log tables are written without a shuffle; rejects are read off the text of a log."""

from pyspark.sql import functions as F

from tallyray.functions.topics import TOPIC
from tallyray.functions.words import uint_to_word
from tallyray.operators import decode as dec
from tallyray.sources import fixtures as fx

LOG = "address string, topics array<string>, data string, block_number long, log_index long, tx_hash string"


def test_logs_of_one_block_range_are_not_one_task(spark, tmp_path):
    n = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 40 * n, numPartitions=n).selectExpr("id % 9000 as block_number", "id as log_index") \
        .withColumn("block_bucket", fx.block_bucket())
    stored = fx.materialize(rows)
    assert len(stored.inputFiles()) == n
    assert stored.columns[-1] == "block_bucket" and stored.count() == 40 * n


def test_words_of_small_and_large_amounts(spark):
    values = [0, 1, 2 ** 63 - 1, 2 ** 63, 2 ** 64, 10 ** 27 + 5, 2 ** 125]
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v"), uint_to_word(F.col("v").cast("decimal(38,0)")).alias("w"))
    assert {r.v: r.w for r in df.collect()} == {str(v): f"{v:064x}" for v in values}


def test_reasons_without_building_values(spark):
    t = lambda name, *more: [TOPIC[name], *more]
    w = lambda n: f"{n:064x}"
    a = "0x" + w(7)
    label = w(160) + w(5) + b"hello".hex().ljust(64, "0")
    logs = [
        ("mint", t("Mint", a, a), "0x" + w(1) + w(2) + w(3), None),
        ("mint_wide_amount", t("Mint", a, a), "0x" + w(1) + w(2 ** 200) + w(3), None),
        ("mint_upper", t("Mint", a.upper().replace("0X", "0x"), a), "0X" + w(1).upper() + w(2) + w(10 ** 27).upper(), None),
        ("mint_part_of_a_word", t("Mint", a, a), "0x" + w(1) + w(2) + w(3) + "f" * 63, None),
        ("mint_short", t("Mint", a, a), "0x" + w(1) + w(2), "malformed"),
        ("mint_long", t("Mint", a, a), "0x" + w(1) + w(2) + w(3) + w(4), "malformed"),
        ("mint_topics", t("Mint", a), "0x" + w(1) + w(2) + w(3), "malformed"),
        ("mint_null_topic", t("Mint", a, None), "0x" + w(1) + w(2) + w(3), "malformed"),
        ("mint_no_hex", t("Mint", a, a), "0x" + w(1) + "g" * 64 + w(3), "malformed"),
        ("cap", t("SupplyCapChanged", a), "0x" + w(1) + w(2 ** 126 - 1), None),
        ("cap_wide", t("SupplyCapChanged", a), "0x" + w(1) + w(2 ** 126), "wide_value"),
        ("ltv_wide", t("CollateralConfigurationChanged", a), "0x" + w(1) + w(2 ** 63) + w(3), "malformed"),
        ("ltv", t("CollateralConfigurationChanged", a), "0x" + w(1) + w(2 ** 63 - 1) + w(3), None),
        ("flag", t("ReservePaused", a), "0x" + w(1), None),
        ("flag_two", t("ReservePaused", a), "0x" + w(2), "malformed"),
        ("emode", t("UserEModeSet", a), "0x" + w(255), None),
        ("emode_256", t("UserEModeSet", a), "0x" + w(256), "malformed"),
        ("category", t("EModeCategoryAdded", "0x" + w(3)), "0x" + w(1) + w(2) + w(3) + w(9) + label, None),
        ("category_cut", t("EModeCategoryAdded", "0x" + w(3)), "0x" + w(1) + w(2) + w(3) + w(9) + w(160) + w(90), "malformed"),
        ("dropped", t("ReserveDropped", a), "0x", None),
        ("null_data", t("ReserveDropped", a), None, "malformed"),
        ("unknown", [a], "0x", "unknown_topic"),
        ("none", [], "0x", "no_topics"),
    ]
    df = spark.createDataFrame([("0x1", topics, data, 5, 1, name) for name, topics, data, _ in logs], LOG)
    out = dec.decode_rejects(df)
    assert {r.tx_hash: r.reason for r in out.collect()} == {name: reason for name, _, _, reason in logs if reason}
    values = [dec._vcol(loc, typ) for loc, typ in dec._needed(["Mint"])]
    assert not any(v in out._jdf.queryExecution().analyzed().toString() for v in values)
