"""Steps that are done once, or not at all, where they were done several times."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from model import random_legs, random_seed_rows
from tallyray.functions.words import hex_body, word_to_uint
from tallyray.operators import positions as pos
from tallyray.plans import catalog
from tallyray.plans import stages as pl
from tallyray.sources import fixtures as fx
from test_ledger import legs_df, seed_df


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_cut_of_a_seed_row_takes_no_join(spark):
    legs, seed = legs_df(spark, random_legs(61)), seed_df(spark, random_seed_rows(61, 30))
    by_row = initial_plan(pos.fold_positions(legs, seed=seed, stale_before="row"))
    fixed = initial_plan(pos.fold_positions(legs, seed=seed, stale_before=(30, -1)))
    assert by_row.count("Join") == fixed.count("Join") and by_row.count("Exchange") == fixed.count("Exchange")


def test_stream_legs_read_their_events_once(spark):
    events = fx.materialize(fx.fx_token_events(spark, SF_SMALL)).drop("arrival")
    legs = catalog._legs_of(spark, SF_SMALL)(events)
    plan = initial_plan(legs)
    assert plan.count("Generate explode") == 1 and "p_partkey" not in plan
    want = pos.kept_legs(pos.legs_from_events(events, catalog.jn.token_map(fx.fx_reserves(spark, SF_SMALL))))
    assert sorted(map(str, legs.collect())) == sorted(map(str, want.collect()))


def test_stream_legs_with_many_reserves(spark, monkeypatch):
    events = fx.materialize(fx.fx_token_events(spark, SF_SMALL)).drop("arrival")
    want = sorted(map(str, catalog._legs_of(spark, SF_SMALL)(events).collect()))
    monkeypatch.setattr(catalog.jn, "fits_broadcast", lambda df, max_rows=0: False)
    assert sorted(map(str, catalog._legs_of(spark, SF_SMALL)(events).collect())) == want


def test_decoded_logs_are_sorted_behind_their_shuffle(spark):
    plan = initial_plan(catalog.first_decoded(fx.fx_raw_token_logs_with_faults(spark, SF_SMALL)))
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_drift_makes_its_legs_once(spark, monkeypatch):
    made, ledger_legs = [], pl.ledger_legs
    monkeypatch.setattr(pl, "ledger_legs", lambda *a: made.append(a) or ledger_legs(*a))
    catalog.q_diagnose_drift(spark, SF_SMALL)
    assert len(made) == 2  # from raw logs, and from events


@pytest.mark.parametrize("text", ["", "0", "0x", "0X", "0xAb", "0XaB", "x0xab", "0x0x12", "00x1", "ab\n0xcd"])
def test_hex_body_drops_one_prefix(spark, text):
    want = (text[2:] if text[:2] in ("0x", "0X") else text).lower()
    assert spark.range(1).select(hex_body(F.lit(text))).first()[0] == want


def test_words_of_all_sizes(spark):
    values = [0, 1, 2 ** 63 - 1, 2 ** 63, 2 ** 64 - 1, 2 ** 64, 2 ** 64 + 5, 10 ** 27, 2 ** 126 - 1, 2 ** 126, 2 ** 255]
    rows = [(f"{v:064x}", v if v < 2 ** 126 else None) for v in values]
    rows += [("0" * 63, None), ("0" * 65, None), ("0" * 63 + "g", None), ("0" * 48 + "F" * 16, None), (None, None)]
    got = spark.createDataFrame([(w,) for w, _ in rows], "w string").select(word_to_uint("w").alias("v")).collect()
    assert [None if r.v is None else int(r.v) for r in got] == [v for _, v in rows]
