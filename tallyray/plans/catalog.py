"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

The names follow the operator inventory; every query reads whole driver
tables through the fixture adapters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uint256 as u256
from ..functions.raymath import burn_delta, mint_delta, ray_div
from ..operators import positions as pos
from ..session import stored
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import stages as pl
from .outputs import present, present_exact, present_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- ledger

@query("fold_positions")
def q_fold_positions(spark, sf):
    return present_positions(pos.fold_positions(pl.ledger_legs(spark, sf)))


@query("position_balances")
def q_position_balances(spark, sf):
    return present_positions(pos.balances(pl.ledger_legs(spark, sf)))


@query("fold_positions_seeded")
def q_fold_positions_seeded(spark, sf):
    seed = fx.fx_position_snapshot(spark, sf)
    out = pos.fold_positions(pl.ledger_legs(spark, sf), seed=seed,
                             stale_before=(fx.SNAPSHOT_BLOCK, -1))
    return present_positions(out)


@query("state_as_of")
def q_state_as_of(spark, sf, at_block: int = 7500):
    legs = pl.ledger_legs(spark, sf).where(F.col("block_number") <= at_block)
    return present_positions(pos.fold_positions(legs))


@query("states_as_of")
def q_states_as_of(spark, sf, steps: int = 8):
    """All positions at the ends of ``steps`` equal parts of the chain."""
    head = read_table(spark, sf, "lineitem").agg(F.max("l_orderkey").alias("head"))
    anchors = head.select("head", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")).select(
        F.expr(f"head * k div {steps}").alias("anchor"))
    return present_positions(pos.states_at(pl.ledger_legs(spark, sf), anchors))


@query("running_balance")
def q_running_balance(spark, sf):
    fx_ = pos.leg_effects(pl.ledger_legs(spark, sf)).where(F.col("kept"))
    shown = present_exact(fx_, ("run_s", "run_d"))
    return shown.select("user_address", "asset_address", "block_number", "log_index", "leg",
                        F.col("run_s").alias("running_supply"), F.col("run_d").alias("running_debt"))


@query("position_legs")
def q_position_legs(spark, sf):
    legs = pl.ledger_legs(spark, sf)
    exact = lambda c: F.coalesce(u256.text(F.col("wide")[c]), F.col(c).cast("string")).alias(c)
    return legs.select("user_address", "asset_address", "block_number", "log_index", "leg",
                       exact("d_supply"), exact("d_debt"), "is_up", "clear", "toggle", "is_self")


@query("touched_pairs")
def q_touched_pairs(spark, sf):
    return pos.touched_pairs(pl.resolved_token_events(spark, sf))


@query("first_delivery")
def q_first_delivery(spark, sf):
    ev = pl.delivered_token_events(spark, sf)
    return present(ev.select("tx_hash", "log_index", "block_number", "address", "event",
                             "from_address", "to_address", "value", "balance_increase",
                             "reserve", "user_address", "enabled"),
                   bigint=("value", "balance_increase"))


@query("resolve_token")
def q_resolve_token(spark, sf):
    r = pl.resolved_token_events(spark, sf)
    return r.select("tx_hash", "log_index", "address", "asset_address", "token_type")


@query("ray_div")
def q_ray_div(spark, sf):
    ev = pl.delivered_token_events(spark, sf).where(F.col("value").isNotNull())
    return present(ev.select("tx_hash", "log_index", ray_div("value", "idx").alias("scaled_value")),
                   text=("scaled_value",))


@query("mint_delta")
def q_mint_delta(spark, sf):
    ev = pl.delivered_token_events(spark, sf).where(F.col("event") == "Mint")
    return present(ev.select("tx_hash", "log_index",
                             (F.col("value") >= F.col("balance_increase")).alias("is_increase"),
                             mint_delta("value", "balance_increase", "idx").alias("delta")),
                   text=("delta",))


@query("burn_delta")
def q_burn_delta(spark, sf):
    ev = pl.delivered_token_events(spark, sf).where(F.col("event") == "Burn")
    return present(ev.select("tx_hash", "log_index",
                             burn_delta("value", "balance_increase", "idx").alias("delta")),
                   text=("delta",))


# ---------------------------------------------------------------- scan, route, decode

from ..functions.address import address_of, normalize_address  # noqa: E402
from ..functions.text import PROVIDER_PATTERNS, RETRYABLE_PATTERNS, first_match, is_provider_error, is_retryable  # noqa: E402,E501
from ..functions.topics import tracked_topics  # noqa: E402
from ..functions.words import config_bit, data_word, word_to_uint  # noqa: E402
from ..operators import decode as dec  # noqa: E402
from ..operators import dedup as dd  # noqa: E402
from ..operators import folds as fo  # noqa: E402
from ..operators import joins as jn  # noqa: E402
from ..operators import reports as rp  # noqa: E402
from ..operators.order import asof_join, guard_newer  # noqa: E402
from ..sources import snapshot as sn  # noqa: E402

POOL = fx.POOL_ID
CONFIGURATOR = fx.POOL_ID + 1


def all_raw_logs(spark, sf):
    tok = fx.fx_raw_token_logs_with_faults(spark, sf).drop("arrival")
    return tok.unionByName(fx.fx_raw_reserve_logs(spark, sf))


def _fixed_contracts(spark):
    return spark.range(1).select(F.explode(F.array(address_of(F.lit(POOL)),
                                                   address_of(F.lit(CONFIGURATOR)))).alias("address"))


@query("tracked_addresses")
def q_tracked_addresses(spark, sf):
    toks = jn.tracked_addresses(fx.fx_reserves(spark, sf))
    return toks.unionByName(_fixed_contracts(spark)).distinct()


@query("scan_logs")
def q_scan_logs(spark, sf, lo: int = 1000, hi: int = 12000):
    from ..sources.logs import scan_logs
    sel = scan_logs(all_raw_logs(spark, sf), lo, hi, q_tracked_addresses(spark, sf),
                    tracked_topics(spark), bucket_blocks=fx.BLOCK_BUCKET)
    return sel.select("address", "block_number", "log_index", "tx_hash", "topic0")


@query("tracked_topics")
def q_tracked_topics(spark, sf):
    logs = all_raw_logs(spark, sf).select(F.lower(F.get(F.col("topics"), 0)).alias("topic0"))
    counts = logs.groupBy("topic0").agg(F.count(F.lit(1)).alias("n_logs"))
    return jn.dim_join(counts, tracked_topics(spark), "topic0", "inner") \
        .select("event", "family", "topic0", "n_logs")


@query("confirmation_lag")
def q_confirmation_lag(spark, sf, confirmations: int = 20):
    logs = fx.fx_raw_token_logs_with_faults(spark, sf).drop("arrival")
    head = logs.select(F.max("block_number")).scalar()
    return logs.where(F.col("block_number") <= head - confirmations) \
        .select("tx_hash", "log_index", "block_number")


@query("route_events")
def q_route_events(spark, sf):
    return dec.route_events(all_raw_logs(spark, sf)).select("tx_hash", "log_index", "event", "family")


@query("decode_token_events")
def q_decode_token_events(spark, sf):
    raw = fx.fx_raw_token_logs_with_faults(spark, sf).drop("arrival")
    d = dec.decode_logs(raw, dec.TOKEN_FAMILY)
    return present(d.select("tx_hash", "log_index", "block_number", "address", "event",
                            "from_address", "to_address", "value", "balance_increase",
                            "reserve", "user_address"),
                   bigint=("value", "balance_increase"))


@query("decode_reserve_events")
def q_decode_reserve_events(spark, sf):
    d = dec.decode_logs(fx.fx_raw_reserve_logs(spark, sf), dec.RESERVE_FAMILY)
    return present(d.select("tx_hash", "log_index", "block_number", "event", "asset",
                            "new_amount", "flag", "ltv", "liquidation_threshold",
                            "liquidation_bonus", "liquidity_rate", "stable_borrow_rate",
                            "variable_borrow_rate", "liquidity_index", "variable_borrow_index",
                            "category_id", "oracle", "label"),
                   bigint=("new_amount", "liquidity_rate", "stable_borrow_rate",
                           "variable_borrow_rate", "liquidity_index", "variable_borrow_index"))


@query("decode_emode_events")
def q_decode_emode_events(spark, sf):
    d = dec.decode_logs(fx.fx_raw_reserve_logs(spark, sf), dec.USER_EMODE_FAMILY)
    return d.select("tx_hash", "log_index", "block_number", "user_address", "category_id")


@query("decode_rejects")
def q_decode_rejects(spark, sf):
    return dec.decode_rejects(all_raw_logs(spark, sf)).select("tx_hash", "log_index", "event", "reason")


@query("word_to_uint")
def q_word_to_uint(spark, sf):
    raw = fx.fx_raw_logs(spark, sf).where(F.length("data") >= 2 + 64 * 2)
    return raw.select("tx_hash", "log_index",
                      word_to_uint(data_word("data", 0)).cast("string").alias("word0"),
                      word_to_uint(data_word("data", 1)).cast("string").alias("word1"))


@query("config_bit")
def q_config_bit(spark, sf):
    reads = fx.fx_reserve_reads(spark, sf)
    return reads.select("asset_address", config_bit(F.col("configuration"), 60).alias("is_paused"))


@query("normalize_address")
def q_normalize_address(spark, sf):
    c = fx.read_table(spark, sf, "customer").select("c_custkey")
    body = F.lpad(F.upper(F.hex("c_custkey")), F.when(F.col("c_custkey") % 7 == 0, 39).otherwise(40), "0")
    messy = F.concat(F.lit("  0X"), body, F.lit(" "))
    return c.select("c_custkey", normalize_address(messy).alias("address"))


# ---------------------------------------------------------------- dedup table

def processed_events(spark, sf):
    ev = fx.fx_token_events(spark, sf)
    return ev.select("tx_hash", "log_index", "block_number")


@query("insert_if_absent")
def q_insert_if_absent(spark, sf, split: int = 7500):
    incoming = processed_events(spark, sf)
    existing = dd.first_delivery(incoming.where(F.col("block_number") < split), ("tx_hash", "log_index"))
    return dd.insert_if_absent(existing, incoming, ("tx_hash", "log_index"))


@query("new_deliveries")
def q_new_deliveries(spark, sf, split: int = 7500):
    incoming = dd.first_delivery(processed_events(spark, sf), ("tx_hash", "log_index"))
    existing = incoming.where(F.col("block_number") < split)
    return dd.new_deliveries(existing, incoming)


@query("delete_older_than")
def q_delete_older_than(spark, sf, retention: int = 100):
    pe = dd.first_delivery(processed_events(spark, sf), ("tx_hash", "log_index"))
    last = pe.select(F.max("block_number")).scalar()
    return dd.delete_older_than(pe, last - retention)


@query("logs_per_range")
def q_logs_per_range(spark, sf, blocks: int = 10):
    logs = fx.fx_raw_logs(spark, sf)
    g = logs.groupBy(F.floor(F.col("block_number") / blocks).cast("bigint").alias("range_start")) \
        .agg(F.count(F.lit(1)).alias("n_logs"))
    return g.select((F.col("range_start") * blocks).alias("range_start"), "n_logs",
                    F.when(F.col("n_logs") > 1000, "halve").when(F.col("n_logs") < 250, "double")
                    .otherwise("keep").alias("chunk_action"))


# ---------------------------------------------------------------- reserves

def reserve_events(spark, sf):
    ev = fx.fx_config_events(spark, sf)
    return dd.first_delivery(ev, ("tx_hash", "log_index"))


RESERVE_BIGINT = ("supply_cap", "borrow_cap", "debt_ceiling", "unbacked_mint_cap")
STATE_BIGINT = ("liquidity_index", "variable_borrow_index", "current_liquidity_rate",
                "current_variable_borrow_rate", "current_stable_borrow_rate", "total_liquidity",
                "total_variable_debt", "total_stable_debt", "accrued_to_treasury", "unbacked",
                "isolation_mode_total_debt")


@query("fold_reserves")
def q_fold_reserves(spark, sf):
    out = fo.fold_reserves(reserve_events(spark, sf), fx.fx_reserves(spark, sf))
    return present(out, bigint=RESERVE_BIGINT)


@query("fold_reserve_state")
def q_fold_reserve_state(spark, sf):
    out = fo.fold_reserve_state(reserve_events(spark, sf), fx.fx_reserve_state(spark, sf))
    return present(out, bigint=STATE_BIGINT)


@query("guard_newer")
def q_guard_newer(spark, sf, split: int = 10000):
    ev = fx.fx_user_emode(spark, sf)
    stored = fo.fold_user_emode(ev.where(F.col("block_number") < split))
    s = stored.select("user_address", F.col("last_updated_block").alias("sb"),
                      F.col("last_updated_log_index").alias("sl"))
    j = ev.join(s, "user_address", "left")
    passed = j.where(F.col("sb").isNull() | guard_newer("sb", "sl", "block_number", "log_index"))
    return passed.select("user_address", "block_number", "log_index", "category_id")


@query("fold_user_emode")
def q_fold_user_emode(spark, sf):
    return fo.fold_user_emode(fx.fx_user_emode(spark, sf))


@query("active_emode_users")
def q_active_emode_users(spark, sf):
    return fo.active_emode_users(fo.fold_user_emode(fx.fx_user_emode(spark, sf)))


@query("load_reserve_snapshot")
def q_load_reserve_snapshot(spark, sf):
    res, _ = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    return present(res, bigint=RESERVE_BIGINT)


@query("load_reserve_state_snapshot")
def q_load_reserve_state_snapshot(spark, sf):
    _, st = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    return present(st, bigint=STATE_BIGINT[2:], text=STATE_BIGINT[:2])


@query("merge_overwrite")
def q_merge_overwrite(spark, sf):
    res, _ = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    out = fo.merge_overwrite(fx.fx_reserves(spark, sf), res)
    return present(out, bigint=RESERVE_BIGINT)


@query("known_reserves")
def q_known_reserves(spark, sf):
    ev = reserve_events(spark, sf)
    return jn.known_reserves(ev, fx.fx_reserves(spark, sf)).select("tx_hash", "log_index", "asset")


@query("missing_reserves")
def q_missing_reserves(spark, sf):
    return jn.missing_reserves(reserve_events(spark, sf), fx.fx_reserves(spark, sf))


@query("count_by_key")
def q_count_by_key(spark, sf):
    ev = reserve_events(spark, sf).select("asset").distinct()
    res = fx.fx_reserves(spark, sf).groupBy(F.col("asset_address").alias("asset")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return ev.join(res, "asset", "left").select("asset", F.coalesce("n", F.lit(0)).alias("n_rows"))


# ---------------------------------------------------------------- eMode

def emode_flag_events(spark, sf):
    return fx.fx_emode_assets(spark, sf)


@query("fold_categories")
def q_fold_categories(spark, sf):
    return fo.fold_categories(fx.fx_emode_category_events(spark, sf))


@query("fold_bitmaps")
def q_fold_bitmaps(spark, sf):
    return fo.fold_bitmaps(emode_flag_events(spark, sf), fx.fx_reserves(spark, sf))


@query("bitmap_members")
def q_bitmap_members(spark, sf):
    return fo.bitmap_members(emode_flag_events(spark, sf), fx.fx_reserves(spark, sf))


@query("emode_categories")
def q_emode_categories(spark, sf):
    return fo.emode_categories(fx.fx_emode_category_events(spark, sf), emode_flag_events(spark, sf),
                               fx.fx_reserves(spark, sf))


@query("missing_categories")
def q_missing_categories(spark, sf):
    cats = fo.fold_categories(fx.fx_emode_category_events(spark, sf)).select("category_id")
    flags = emode_flag_events(spark, sf).withColumn("category_id", F.col("category_id") + 4)
    miss = flags.join(cats, "category_id", "left_anti")
    return miss.groupBy("category_id").agg(F.min("block_number").alias("first_block"),
                                           F.count(F.lit(1)).alias("n_events"))


@query("load_emode_snapshot")
def q_load_emode_snapshot(spark, sf):
    ev = fx.fx_emode_category_events(spark, sf)
    nxt = ((F.col("category_id") + 1) % 8).cast("int")
    reads = ev.select("block_number", "log_index", F.array(
        F.struct(F.col("category_id").alias("id"), "ltv", "liquidation_threshold",
                 "liquidation_bonus", "oracle", "label"),
        F.struct(nxt.alias("id"), (F.col("ltv") + 1).alias("ltv"), "liquidation_threshold",
                 "liquidation_bonus", "oracle", F.concat(F.col("label"), F.lit("+")).alias("label")))
        .alias("emodes"))
    return sn.load_emode_snapshot(reads)


# ---------------------------------------------------------------- snapshots, reports

@query("load_position_snapshot")
def q_load_position_snapshot(spark, sf):
    return present_positions(sn.load_position_snapshot(fx.fx_snapshot_pages(spark, sf),
                                                       fx.SNAPSHOT_BLOCK))


@query("orphan_check")
def q_orphan_check(spark, sf):
    rej = sn.snapshot_rejects(fx.fx_snapshot_pages(spark, sf), fx.fx_reserves(spark, sf))
    return rej


@query("orphan_state")
def q_orphan_state(spark, sf):
    """Loaded reserve-state rows whose reserve is not in the reserves table."""
    _, st = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    return jn.orphan_check(st, fx.fx_reserves(spark, sf)).select("asset_address")


def folded_positions(spark, sf):
    return pos.fold_positions(pl.ledger_legs(spark, sf))


def seeded_positions(spark, sf):
    return pos.fold_positions(pl.ledger_legs(spark, sf), seed=fx.fx_position_snapshot(spark, sf),
                              stale_before=(fx.SNAPSHOT_BLOCK, -1))


@query("positions_with_tokens")
def q_positions_with_tokens(spark, sf):
    p = rp.positions_with_tokens(folded_positions(spark, sf), fx.fx_reserves(spark, sf))
    return present_positions(p).select("user_address", "asset_address", "scaled_atoken_balance",
                                       "scaled_variable_debt", "last_updated_block", "atoken_address",
                                       "v_debt_token_address")


@query("above_dust")
def q_above_dust(spark, sf):
    return present_positions(rp.above_dust(folded_positions(spark, sf)))


@query("changed_after")
def q_changed_after(spark, sf):
    return present_positions(rp.changed_after(seeded_positions(spark, sf), 7500))


@query("snapshot_only")
def q_snapshot_only(spark, sf):
    return present_positions(rp.snapshot_only(seeded_positions(spark, sf)))


@query("nonzero_positions")
def q_nonzero_positions(spark, sf):
    return present_positions(rp.nonzero_positions(seeded_positions(spark, sf)))


@query("lookup_keys")
def q_lookup_keys(spark, sf):
    users = fo.active_emode_users(fo.fold_user_emode(fx.fx_user_emode(spark, sf)))
    return present_positions(rp.lookup_keys(folded_positions(spark, sf), users, ["user_address"]))


@query("lookup_keys_categories")
def q_lookup_keys_categories(spark, sf):
    """The category rows of all categories that users are in."""
    users = fo.active_emode_users(fo.fold_user_emode(fx.fx_user_emode(spark, sf)))
    return rp.lookup_keys(fo.fold_categories(fx.fx_emode_category_events(spark, sf)),
                          users.select(F.col("emode_category_id").alias("category_id")), ["category_id"])


@query("lookup_keys_reserve_ids")
def q_lookup_keys_reserve_ids(spark, sf):
    """The reserves behind the ids that are set in any bitmap."""
    reserves = fx.fx_reserves(spark, sf)
    ids = fo.bitmap_members(emode_flag_events(spark, sf), reserves)
    return rp.lookup_keys(reserves, ids, ["reserve_id"]).select("asset_address", "reserve_id", "symbol")


@query("oldest_positions")
def q_oldest_positions(spark, sf, n: int = 100):
    p = rp.above_dust(folded_positions(spark, sf))
    return present_positions(rp.oldest(p, n, ["last_updated_block", "user_address", "asset_address"]))


@query("systematic_sample")
def q_systematic_sample(spark, sf, k: int = 30):
    pairs = pos.touched_pairs(pl.resolved_token_events(spark, sf))
    return rp.systematic_sample(pairs, k, ["user_address", "asset_address"])


def raw_path_positions(spark, sf):
    """The same ledger, but from raw logs: decode (faulty copies go to the
    rejects) -> first delivery -> resolve -> legs -> fold."""
    return pos.fold_positions(pl.ledger_legs(spark, sf, first_decoded(fx.fx_raw_token_logs_with_faults(spark, sf))))


def first_decoded(raw):
    """Token events decoded from raw logs, one copy per (tx_hash, log_index).  A key has as many copies as logs at most."""
    keys = ("tx_hash", "log_index")
    typed = dec.decode_logs(raw, dec.TOKEN_FAMILY, keep=("arrival",))
    return dd.first_delivery(typed, keys, order="arrival", tasks=dd.delivery_tasks(raw, keys)).drop("arrival")


@query("reconcile")
def q_reconcile(spark, sf):
    rec = rp.reconcile(raw_path_positions(spark, sf), folded_positions(spark, sf))
    return present_exact(rec, rp.COMPARED)


@query("pass_fail_summary")
def q_pass_fail_summary(spark, sf):
    return rp.pass_fail_summary(rp.reconcile(raw_path_positions(spark, sf), folded_positions(spark, sf)))


@query("classify_error_text")
def q_classify_error_text(spark, sf):
    m = fx.fx_messages(spark, sf)
    return m.select("source", "message_id", is_retryable("message").alias("is_retryable"),
                    is_provider_error("message").alias("is_provider_error"),
                    first_match("message", RETRYABLE_PATTERNS).alias("retryable_match"),
                    first_match("message", PROVIDER_PATTERNS).alias("provider_match"))


@query("asof_contract_read")
def q_asof_contract_read(spark, sf):
    probes = fx.fx_read_probes(spark, sf)
    reads = fx.fx_contract_reads(spark, sf)
    return asof_join(probes, reads, "entity", ["value"])


@query("diagnose_drift")
def q_diagnose_drift(spark, sf, tolerance: int = rp.TOLERANCE):
    """Failing reconcile rows: was the mismatch already there at the creation
    block, did it arise later, or is it within tolerance?"""
    # each is read more than once: computed once
    comp = stored(raw_path_positions(spark, sf), "computed")
    legs = stored(pl.ledger_legs(spark, sf), "legs")
    rec = rp.reconcile(comp, pos.fold_positions(legs, materialize=False), tolerance)
    failing = stored(rec.where(~F.col("within_tolerance")).join(
        comp.select("user_address", "asset_address", "created_at_block", "last_updated_block"),
        ["user_address", "asset_address"], "inner"), "failing")
    pair = F.concat_ws("|", "user_address", "asset_address")
    # a balance hangs on its own pair's legs only: the history of the failing pairs
    own = legs.join(failing.select(*pos.KEY).distinct(), pos.KEY, "left_semi")
    hist = stored(pos.leg_effects(own).where(F.col("kept")).select(
        pair.alias("pair"), "block_number", (F.col("log_index") * 10 + F.col("leg")).alias("log_index"),
        F.col("run_s").alias("exp_s"), F.col("run_d").alias("exp_d")), "history")
    f = failing.select(pair.alias("pair"), "user_address", "asset_address", "computed_supply",
                       "computed_debt", "diff_supply", "diff_debt", "created_at_block",
                       "last_updated_block")
    at_c = asof_join(f.withColumn("block_number", F.col("created_at_block")), hist, "pair",
                     ["exp_s", "exp_d"]).withColumnRenamed("exp_s", "c_s").withColumnRenamed("exp_d", "c_d")
    both = asof_join(at_c.drop("block_number").withColumn("block_number", F.col("last_updated_block")),
                     hist, "pair", ["exp_s", "exp_d"]).withColumnRenamed("exp_s", "u_s") \
        .withColumnRenamed("exp_d", "u_d")
    both = stored(both, "drift")
    z = F.lit(0).cast("decimal(38,0)")
    rows = []
    for side, comp_c, diff_c, c_at, u_at in [("supply", "computed_supply", "diff_supply", "c_s", "u_s"),
                                            ("debt", "computed_debt", "diff_debt", "c_d", "u_d")]:
        dc = F.abs(F.col(comp_c) - F.coalesce(F.col(c_at), z))
        du = F.abs(F.col(comp_c) - F.coalesce(F.col(u_at), z))
        rows.append(both.where(F.col(diff_c) > tolerance).select(
            "user_address", "asset_address", F.lit(side).alias("side"),
            F.col(diff_c).cast("string").alias("diff"), dc.cast("string").alias("diff_at_created"),
            du.cast("string").alias("diff_at_updated"),
            rp.classify_drift(F.col(diff_c), dc, du).alias("origin")))
    return rows[0].unionByName(rows[1])


@query("checksum_address")
def q_checksum_address(spark, sf):
    from ..functions.address import with_checksum
    users = folded_positions(spark, sf).select("user_address").distinct()
    return with_checksum(users, "user_address", "user_checksum")


# ---------------------------------------------------------------- wide amounts

def wide_events(spark, sf):
    """Token events decoded from logs with amounts beyond 38 digits, one copy per (tx_hash, log_index)."""
    return first_decoded(fx.fx_raw_wide_logs(spark, sf))


@query("decode_wide_amounts")
def q_decode_wide_amounts(spark, sf):
    d = dec.decode_logs(fx.fx_raw_wide_logs(spark, sf), dec.TOKEN_FAMILY).where(F.col("event").isin(*dec.AMOUNT_EVENTS))
    exact = lambda c: F.coalesce(u256.text(F.col("exact")[c]), F.col(c).cast("string")).alias(c)
    return d.select("tx_hash", "log_index", "event", exact("value"), exact("balance_increase"), exact("idx"))


@query("fold_positions_wide")
def q_fold_positions_wide(spark, sf):
    return present_positions(pos.fold_positions(pl.ledger_legs(spark, sf, wide_events(spark, sf))))


@query("running_balance_wide")
def q_running_balance_wide(spark, sf):
    runs = pos.leg_effects(pl.ledger_legs(spark, sf, wide_events(spark, sf))).where(F.col("kept"))
    return present_exact(runs, ("run_s", "run_d")).select(
        "user_address", "asset_address", "block_number", "log_index", "leg",
        F.col("run_s").alias("running_supply"), F.col("run_d").alias("running_debt"))


@query("ledger_rejects")
def q_ledger_rejects(spark, sf):
    return pos.ledger_rejects(pl.all_legs(spark, sf, wide_events(spark, sf)))


# ---------------------------------------------------------------- streaming

ROWS_PER_FILE = 500_000      # well below the size at which a scan splits a file
ROWS_PER_RANGE = 10_000_000  # bounds a micro-batch and its state


def _write_ranges(logs, src, n_ranges: int, order=(), newest_first: bool = False, prefix: str = "range="):
    """Write logs as chain-ordered folders ``range=<i>``, one per block range
    and at least ``n_ranges``, each of the same number of files, so that a
    trigger of so many files takes one range (:func:`_ranges`).

    With an ``order`` all copies of a log are in one file, in that order: the
    files of a range may be read in any order.
    """
    found = logs.select(F.max("block_number").alias("top"), F.count(F.lit(1)).alias("n")).first()
    n_ranges = max(n_ranges, -(-found.n // ROWS_PER_RANGE))
    files = max(1, -(-found.n // (n_ranges * ROWS_PER_FILE)))
    width = (found.top or 0) // n_ranges + 1
    none = logs.limit(0).coalesce(1)
    for i in reversed(range(n_ranges)) if newest_first else range(n_ranges):
        part = logs.where(F.col("block_number").between(i * width, (i + 1) * width - 1))
        part = part.repartition(files, "tx_hash", "log_index").sortWithinPartitions(*order) if order else part.coalesce(files)
        path = f"{src}/{prefix}{i:04d}"
        part.write.mode("overwrite").parquet(path)
        for _ in range(files - len(logs.sparkSession.read.schema(logs.schema).parquet(path).inputFiles())):
            none.write.mode("append").parquet(path)  # a task without rows writes no file


def _ranges(spark, src, schema) -> tuple[list[str], int]:
    """The range folders under ``src`` and the number of files in each."""
    held = [f.rsplit("/", 2)[-2] for f in spark.read.schema(schema).parquet(f"{src}/*").inputFiles()]
    folders = sorted(set(held))
    return folders, len(held) // len(folders)


def _stream_source(spark, sf, n_ranges: int = 4):
    """Write the token events as chain-ordered files (one write per block
    range) into a fresh folder under the shared checkpoint folder."""
    import uuid

    from ..session import state_root
    root = state_root(spark, f"stream-{uuid.uuid4().hex[:12]}")
    ev = fx.materialize(fx.fx_token_events(spark, sf), ("token_events", sf))
    # rows of a file in delivery order (block, log, arrival)
    _write_ranges(ev, f"{root}/src", n_ranges, ("block_number", "log_index", "arrival"))
    return root, ev.schema


def _legs_of(spark, sf):
    """Events -> legs.  The token map is made once a run; when reserves are many, a batch takes the map of its emitters."""
    tokens = stored(jn.token_map(fx.fx_reserves(spark, sf)), "tokens")
    few = jn.fits_broadcast(tokens)

    def legs_of(events):
        tm = tokens if few or events.isStreaming else jn.dim_join(tokens, jn.emitters(events), "token", "left_semi")
        return pos.kept_legs(pos.legs_from_events(events, tm))
    return legs_of


@query("stream_apply")
def q_stream_apply(spark, sf):
    from ..streaming.apply import stream_apply
    root, schema = _stream_source(spark, sf)
    out = stream_apply(spark, f"{root}/src/*", schema, _legs_of(spark, sf),
                       name=root.rsplit("/", 1)[-1] + "-state",
                       max_files_per_trigger=_ranges(spark, f"{root}/src", schema)[1])
    return present_positions(out)


@query("stream_dedup")
def q_stream_dedup(spark, sf):
    from ..streaming.apply import stream_dedup
    root, schema = _stream_source(spark, sf)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", _ranges(spark, f"{root}/src", schema)[1]) \
        .parquet(f"{root}/src/*")
    d = stream_dedup(s).select("tx_hash", "log_index", "block_number")
    q = (d.writeStream.format("parquet").option("path", f"{root}/dedup")
         .option("checkpointLocation", f"{root}/dedup_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/dedup")


@query("stream_once")
def q_stream_once(spark, sf, n_ranges: int = 4):
    """Deliveries in the worst order: block ranges from the newest to the oldest, all of them twice."""
    import uuid

    from ..session import state_root
    from ..streaming.apply import stream_once
    root = state_root(spark, f"once-{uuid.uuid4().hex[:12]}")
    ev = fx.materialize(fx.fx_token_events(spark, sf), ("token_events", sf))
    for turn in range(2):
        _write_ranges(ev, f"{root}/src", n_ranges, newest_first=True, prefix=f"delivery={turn}")
    files = _ranges(spark, f"{root}/src", ev.schema)[1]
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/src/*")
    stream_once(src, f"{root}/kept", f"{root}/ckpt", order="arrival").awaitTermination()
    return spark.read.parquet(f"{root}/kept").select("tx_hash", "log_index", "block_number")


@query("stateful_positions")
def q_stateful_positions(spark, sf):
    from ..streaming.apply import stateful_positions, stream_dedup
    root, schema = _stream_source(spark, sf)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", _ranges(spark, f"{root}/src", schema)[1]) \
        .parquet(f"{root}/src/*")
    ev = stream_dedup(s).drop("event_time", "arrival")
    legs = _legs_of(spark, sf)(ev)
    out = stateful_positions(legs)

    def sink(df, batch_id):
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(f"{root}/state_out")

    q = (out.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", f"{root}/state_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{root}/state_out")
    latest = rows.groupBy("user_address", "asset_address").agg(
        F.max_by(F.struct(*[c for c in rows.columns if c not in ("user_address", "asset_address",
                                                                  "batch_id")]),
                 "batch_id").alias("r"))
    cols = [c for c in rows.columns if c not in ("user_address", "asset_address", "batch_id")]
    res = latest.select("user_address", "asset_address", *[F.col("r").getField(c).alias(c) for c in cols])
    return res


# ---------------------------------------------------------------- more inventory

@query("entity_key")
def q_entity_key(spark, sf):
    d = dec.decode_logs(fx.fx_raw_reserve_logs(spark, sf), dec.RESERVE_FAMILY)
    return d.select("tx_hash", "log_index", "event", dec.entity_key(d).alias("entity"))


@query("token_union")
def q_token_union(spark, sf):
    return jn.token_map(fx.fx_reserves(spark, sf))


@query("load_bitmap_as_of")
def q_load_bitmap_as_of(spark, sf):
    """Each asset-flag event with its category's configuration as of that block."""
    probes = emode_flag_events(spark, sf).select("category_id", "block_number", "log_index",
                                                 "asset", "bitmap", "flag")
    reads = fx.fx_emode_category_events(spark, sf).select(
        "category_id", "block_number", "log_index", "ltv", "label")
    return asof_join(probes, reads, "category_id", ["ltv", "label"])


@query("bitmaps_as_of")
def q_bitmaps_as_of(spark, sf):
    """The three bitmaps of a category at the block of every category event."""
    probes = fx.fx_emode_category_events(spark, sf).select("category_id", "block_number", "log_index")
    return fo.bitmaps_as_of(probes, emode_flag_events(spark, sf), fx.fx_reserves(spark, sf))


@query("merge_overwrite_state")
def q_merge_overwrite_state(spark, sf):
    _, st = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    out = fo.merge_overwrite(fx.fx_reserve_state(spark, sf), st)
    return present(out, bigint=STATE_BIGINT[2:], text=STATE_BIGINT[:2])


@query("insert_if_absent_positions")
def q_insert_if_absent_positions(spark, sf):
    # read twice, for its rows and for its keys: folded once
    existing = stored(present_positions(folded_positions(spark, sf)), "positions")
    incoming = sn.load_position_snapshot(fx.fx_snapshot_pages(spark, sf), fx.SNAPSHOT_BLOCK)
    # a row of an unknown reserve breaks the foreign key: it is an orphan (orphan_check), not a position
    incoming = jn.known_reserves(incoming, fx.fx_reserves(spark, sf), "asset_address")
    return dd.insert_if_absent(existing, present_positions(incoming), ["user_address", "asset_address"])


@query("late_guard")
def q_late_guard(spark, sf, split: int = 10000):
    """Re-delivered / late UserEModeSet events that the guard turns into no-ops."""
    ev = fx.fx_user_emode(spark, sf)
    stored = fo.fold_user_emode(ev.where(F.col("block_number") < split))
    s = stored.select("user_address", F.col("last_updated_block").alias("sb"),
                      F.col("last_updated_log_index").alias("sl"))
    j = ev.join(s, "user_address", "inner")
    return j.where(~guard_newer("sb", "sl", "block_number", "log_index")) \
        .select("user_address", "block_number", "log_index", "category_id")


@query("stream_logs")
def q_stream_logs(spark, sf):
    """Raw logs read as a stream and routed per micro-batch."""
    import uuid

    from ..session import state_root
    root = state_root(spark, f"logs-{uuid.uuid4().hex[:12]}")
    raw = fx.fx_raw_token_logs_with_faults(spark, sf).drop("arrival")
    _write_ranges(raw, f"{root}/src", 4)
    s = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", _ranges(spark, f"{root}/src", raw.schema)[1]) \
        .parquet(f"{root}/src/*")
    routed = dec.route_events(s).select("tx_hash", "log_index", "event", "family")
    q = (routed.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("resume")
def q_resume(spark, sf):
    """Incremental apply stopped after half of the log and restarted from its
    checkpoint with the rest: the result equals one uninterrupted run."""
    from ..streaming.apply import stream_apply
    root, schema = _stream_source(spark, sf, n_ranges=4)
    name = root.rsplit("/", 1)[-1] + "-state"
    folders, files = _ranges(spark, f"{root}/src", schema)
    half = ",".join(folders[:len(folders) // 2])
    # first run sees the first half of the ranges only
    stream_apply(spark, f"{root}/src/{{{half}}}", schema, _legs_of(spark, sf), name=name, max_files_per_trigger=files)
    # restart: same checkpoint, the full set; processed files are skipped
    out = stream_apply(spark, f"{root}/src/*", schema, _legs_of(spark, sf), name=name, max_files_per_trigger=files)
    return present_positions(out)


@query("fold_reserves_healed")
def q_fold_reserves_healed(spark, sf):
    """Reserve fold where reserves missing at their first event are loaded from
    contract reads as of that block first (self-healing), then folded."""
    ev = reserve_events(spark, sf)
    seed = fx.fx_reserves(spark, sf)
    reads, _ = sn.load_reserve_snapshot(fx.fx_reserve_reads(spark, sf))
    healed = fo.heal_missing(ev.where(F.col("event") != "ReserveInitialized"), seed,
                             reads.select(*seed.columns))
    return present(fo.fold_reserves(ev, seed.unionByName(healed)), bigint=RESERVE_BIGINT)


@query("word_to_address")
def q_word_to_address(spark, sf):
    from ..functions.words import topic_word, word_to_address
    raw = fx.fx_raw_logs(spark, sf).where(F.size("topics") == 3)
    return raw.select("tx_hash", "log_index",
                      word_to_address(topic_word(F.col("topics"), 1)).alias("address1"),
                      word_to_address(topic_word(F.col("topics"), 2)).alias("address2"))


@query("word_to_long")
def q_word_to_long(spark, sf):
    from ..functions.words import word_to_long
    raw = dec.route_events(fx.fx_raw_reserve_logs(spark, sf)) \
        .where(F.col("event") == "CollateralConfigurationChanged")
    return raw.select("tx_hash", "log_index", *[word_to_long(data_word("data", i)).alias(f"w{i}")
                                                for i in range(3)])


@query("created_at")
def q_created_at(spark, sf):
    return folded_positions(spark, sf).select("user_address", "asset_address", "created_at_block")


@query("parse_decimal")
def q_parse_decimal(spark, sf):
    rows = sn.snapshot_rows(fx.fx_snapshot_pages(spark, sf))
    return present(rows.select("id", "scaled_atoken_balance", "scaled_variable_debt", "atoken_last_index"),
                   text=("scaled_atoken_balance", "scaled_variable_debt", "atoken_last_index"))


@query("write_state")
def q_write_state(spark, sf):
    """Fold positions and reserves and commit both as one state version (data
    folders first, one pointer last), then read the committed positions."""
    import uuid

    from ..session import state_root
    from ..streaming.apply import VersionedState
    pos_df = folded_positions(spark, sf)
    res_df = fo.fold_reserves(reserve_events(spark, sf), fx.fx_reserves(spark, sf))
    st = VersionedState(spark, state_root(spark, f"state-{uuid.uuid4().hex[:12]}"),
                        {"positions": pos_df.schema, "reserves": res_df.schema})
    st.commit({"positions": pos_df, "reserves": res_df}, 0)
    return present_positions(st.read("positions"))
