"""Stream sources of many files a range, keyed state shared by pairs, legs stored once."""

import uuid

import pandas as pd

from tallyray.plans import catalog as cat
from tallyray.session import state_root
from tallyray.streaming import apply as ap


def logs(spark, n):
    # every log comes twice, one transaction holds a third of them
    rows = [(f"t{0 if i % 3 == 0 else i}", i, 4 * i, copy) for i in range(n) for copy in (1, 0)]
    return spark.createDataFrame(rows, "tx_hash string, log_index long, block_number long, arrival int")


def test_every_range_has_the_same_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(cat, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(cat, "ROWS_PER_RANGE", 60)
    src = state_root(spark, f"test-ranges-{uuid.uuid4().hex[:8]}")
    df = logs(spark, 150)
    cat._write_ranges(df, src, 2, ("block_number", "log_index", "arrival"))
    folders, files = cat._ranges(spark, src, df.schema)
    assert len(folders) == 5 and files == 3
    back = spark.read.schema(df.schema).parquet(f"{src}/*").selectExpr("*", "_metadata.file_path as f").collect()
    assert sorted(r[:4] for r in back) == sorted(tuple(r) for r in df.collect())
    at = {}
    for r in back:
        at.setdefault((r.tx_hash, r.log_index), []).append((r.f, r.arrival))
    assert all(len({f for f, _ in v}) == 1 and [a for _, a in v] == [0, 1] for v in at.values())


def test_a_range_without_rows_still_has_its_files(spark, monkeypatch):
    monkeypatch.setattr(cat, "ROWS_PER_FILE", 2)
    src = state_root(spark, f"test-ranges-{uuid.uuid4().hex[:8]}")
    df = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 900, 0)] + [("c", 0, 1000, k) for k in range(20)],
                               "tx_hash string, log_index long, block_number long, arrival int")
    cat._write_ranges(df, src, 4, ("block_number", "log_index", "arrival"))
    folders, files = cat._ranges(spark, src, df.schema)
    assert len(folders) == 4 and files == 3
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{src}/*")
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.block_number for r in b.select("block_number").distinct().collect()))) \
        .option("checkpointLocation", src + "-ckpt").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[0], [], [], [900, 1000]]


class State:
    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def test_pairs_of_a_bucket_share_one_state():
    cols = ["user_address", "asset_address", "block_number", "log_index", "leg", "d_supply", "d_debt", "s_index", "d_index",
            "is_up", "clear", "toggle"]
    up = lambda u, a, b, d: (u, a, b, 1, 0, str(d), "0", "7", None, True, None, None)
    burn = lambda u, a, b, d: (u, a, b, 1, 0, str(-d), "0", "8", None, False, "S", None)
    first = [up("u", "x", 5, 10), burn("v", "x", 1, 3), up("v", "y", 2, 10 ** 40), up("u", "x", 4, 1)]
    second = [burn("u", "x", 6, 11), up("u", "x", 3, 99)]
    state, got = State(), []
    for rows in (first, second):
        df = pd.DataFrame(rows, columns=cols)
        got.append({(r.user_address, r.asset_address): r for r in pd.concat(list(ap._state_fn((1,), [df[:1], df[1:]], state))).itertuples()})
    assert set(got[0]) == {("u", "x"), ("v", "y")} and set(got[1]) == {("u", "x")}
    assert got[0]["v", "y"].scaled_atoken_balance == str(10 ** 40)
    assert (got[0]["u", "x"].scaled_atoken_balance, got[0]["u", "x"].created_at_block) == ("11", 4)
    last = got[1]["u", "x"]
    assert (last.scaled_atoken_balance, last.is_active, last.last_updated_block, last.atoken_last_index) == ("0", False, 6, "8")
    assert len(state.value[0]) == 2


def test_legs_are_stored_as_columns(spark):
    from test_ledger import legs_df
    from model import random_legs
    from tallyray.operators.positions import leg_effects
    out = leg_effects(legs_df(spark, random_legs(5)))
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.inputFiles() and all("/tables/legs-" in f for f in out.inputFiles())
