"""Adapters that project the driver's tables into the ledger model.

The test tables hold no chain logs; each adapter is a narrow, deterministic
projection (no shuffle) of one table, so every query built on them grows with
the input.  The mappings are those of FIXTURES.md section 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import address_of
from ..functions.topics import TOPIC
from ..functions.uint256 import let
from ..functions.words import D38, address_to_word, dlit, uint_to_word
from ..session import checkpoint_dir
from .tables import read_table

RAY = 10 ** 27
N_ASSETS = 50          # an event's key k is on the asset of k % 50
N_KNOWN_RESERVES = 45  # of 50 consecutive keys, the first 45 name listed reserves, the others unlisted assets
UNLISTED = 10 ** 9     # asset ids from here on are unlisted
SNAPSHOT_BLOCK = 5000
POOL_ID = 0xA11CE      # synthetic pool / configurator emitter

# The lineitem (returnflag || linestatus) code of each token action.
KIND_ATOKEN_MINT = "RF"
KIND_ATOKEN_BURN = "RO"
KIND_DEBT_MINT = "NF"
KIND_DEBT_BURN = "NO"
KIND_TRANSFER = "AF"
KIND_COLLATERAL = "AO"


def tx_hash_of(n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n.cast("bigint"))), 64, "0"))


def pool_address() -> Column:
    return address_of(F.lit(POOL_ID))


def asset_id(key) -> Column:
    """The asset a key names: the reserve of that ``p_partkey``, or an unlisted asset."""
    key = key.cast("bigint")
    return F.when(key % N_ASSETS < N_KNOWN_RESERVES, key).otherwise(key + UNLISTED)


# Token addresses lie beyond every asset id, each kind in a range of its own.
ATOKEN_BASE, S_DEBT_BASE, STRATEGY_BASE = 10 ** 10, 2 * 10 ** 10, 3 * 10 ** 10


def atoken_of(r) -> Column:
    return address_of(F.lit(ATOKEN_BASE) + r * 2)


def debt_token_of(r) -> Column:
    return address_of(F.lit(ATOKEN_BASE + 1) + r * 2)


def ray_index_of(partkey) -> Column:
    return (dlit(RAY) + partkey.cast(D38) * dlit(10 ** 21)).cast(D38)


# ---------------------------------------------------------------- token logs

def fx_token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> decoded token and collateral events (one row per log).

    Columns: block_number, log_index, tx_hash, address (emitter), event,
    from_address, to_address, value, balance_increase, idx, reserve,
    user_address, enabled, arrival (delivery order of duplicate copies).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    kind = F.concat("l_returnflag", "l_linestatus")
    r = asset_id(F.col("l_partkey") % N_ASSETS)
    value = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    user = address_of(F.col("l_suppkey"))
    peer = address_of((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 100)
    is_a = kind.isin(KIND_ATOKEN_MINT, KIND_ATOKEN_BURN, KIND_TRANSFER)
    event = (F.when(kind.isin(KIND_ATOKEN_MINT, KIND_DEBT_MINT), "Mint")
             .when(kind.isin(KIND_ATOKEN_BURN, KIND_DEBT_BURN), "Burn")
             .when(kind == KIND_TRANSFER, "BalanceTransfer")
             .when(F.col("l_discount") >= 0.05, "ReserveUsedAsCollateralEnabled")
             .otherwise("ReserveUsedAsCollateralDisabled"))
    is_coll = kind == KIND_COLLATERAL
    df = li.select(
        F.col("l_orderkey").cast("bigint").alias("block_number"),
        F.col("l_linenumber").cast("bigint").alias("log_index"),
        tx_hash_of("l_orderkey").alias("tx_hash"),
        F.when(is_coll, pool_address()).when(is_a, atoken_of(r))
         .otherwise(debt_token_of(r)).alias("address"),
        event.alias("event"),
        F.when(~is_coll, user).alias("from_address"),
        F.when(is_coll, None).when(kind == KIND_TRANSFER, peer).otherwise(user).alias("to_address"),
        F.when(~is_coll, value.cast(D38)).alias("value"),
        F.when(~is_coll & (kind != KIND_TRANSFER), F.expr(
            "cast(round(l_extendedprice * 100) as bigint) * "
            "cast(round(l_discount * 100) as bigint) div 5").cast(D38)).alias("balance_increase"),
        F.when(~is_coll, ray_index_of(F.col("l_partkey"))).alias("idx"),
        F.when(is_coll, address_of(r)).alias("reserve"),
        F.when(is_coll, user).alias("user_address"),
        F.when(is_coll, F.col("l_discount") >= 0.05).alias("enabled"),
        F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
                 value.alias("v"), F.expr(
                     "cast(round(l_extendedprice * 100) as bigint) * "
                     "cast(round(l_discount * 100) as bigint) div 5").alias("i"),
                 F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"),
                 kind.alias("k")).alias("arrival"),
    )
    return df


def fx_raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token/collateral events encoded as raw logs (address, topics, data),
    stored as parquet with their ``block_bucket``."""
    return materialize(_encode_token_events(fx_token_events(spark, sf_dir)),
                       ("raw_token_logs", sf_dir))


# ---------------------------------------------------------------- reserves

def fx_reserves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> seed rows of the ``reserves`` table at ordkey (0, -1), one per part."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    r = F.col("p_partkey")
    return p.select(
        address_of(r).alias("asset_address"),
        F.col("p_name").alias("symbol"),
        F.col("p_size").cast("bigint").alias("decimals"),
        r.cast("int").alias("reserve_id"),
        F.lit(8500).cast("bigint").alias("liquidation_threshold"),
        F.lit(10500).cast("bigint").alias("liquidation_bonus"),
        F.lit(8000).cast("bigint").alias("ltv"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_frozen"),
        F.lit(False).alias("is_paused"),
        F.lit(True).alias("is_borrowing_enabled"),
        F.lit(False).alias("is_dropped"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").cast(D38).alias("supply_cap"),
        F.lit(500000).cast(D38).alias("borrow_cap"),
        F.lit(1000).cast("bigint").alias("reserve_factor"),
        F.lit(True).alias("is_collateral_enabled"),
        F.lit(False).alias("is_stable_borrow_enabled"),
        F.lit(True).alias("is_flash_loan_enabled"),
        F.lit(0).cast(D38).alias("debt_ceiling"),
        F.lit(1000).cast("bigint").alias("liquidation_protocol_fee"),
        F.lit(False).alias("is_siloed_borrowing"),
        F.lit(0).cast(D38).alias("unbacked_mint_cap"),
        atoken_of(r).alias("atoken_address"),
        debt_token_of(r).alias("v_debt_token_address"),
        address_of(F.lit(3)).alias("s_debt_token_address"),
        address_of(F.lit(4)).alias("interest_rate_strategy_address"),
        F.lit(0).cast("bigint").alias("last_updated_block"),
        F.lit(-1).cast("bigint").alias("last_updated_log_index"),
    )


def fx_reserve_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = fx_reserves(spark, sf_dir)
    one, zero = F.lit(1).cast(D38), F.lit(0).cast(D38)
    return res.select(
        "asset_address",
        one.alias("liquidity_index"), one.alias("variable_borrow_index"),
        zero.alias("current_liquidity_rate"), zero.alias("current_variable_borrow_rate"),
        zero.alias("current_stable_borrow_rate"), zero.alias("total_liquidity"),
        zero.alias("total_variable_debt"), zero.alias("total_stable_debt"),
        zero.alias("accrued_to_treasury"), zero.alias("unbacked"),
        zero.alias("isolation_mode_total_debt"),
        "last_updated_block", "last_updated_log_index")


def _event_clock(df: DataFrame) -> list[Column]:
    return [
        F.floor(F.unix_timestamp("ts") / 12).cast("bigint").alias("block_number"),
        F.col("event_id").cast("bigint").alias("log_index"),
        tx_hash_of("event_id").alias("tx_hash"),
    ]


def fx_config_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> decoded reserve-configuration events (wide nullable schema)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                                   "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    amount = F.round(F.col("value") * 100).cast("bigint")
    et = F.col("event_type")
    name = (F.when(et == "purchase", "SupplyCapChanged")
            .when((et == "signup") & (k % 2 == 0), "ReserveFrozen")
            .when(et == "signup", "ReserveUnfrozen")
            .when(et == "view", "ReservePaused")
            .when(et == "click", "CollateralConfigurationChanged")
            .when(et == "error", "ReserveDataUpdated"))
    dec = lambda c: c.cast(D38)
    return e.select(
        *_event_clock(e),
        address_of(asset_id(F.col("user_id") % N_ASSETS)).alias("asset"),
        name.alias("event"),
        F.when(et == "purchase", dec(amount)).alias("new_amount"),
        F.when(et == "view", k % 2 == 0).alias("flag"),
        F.when(et == "click", amount).alias("ltv"),
        F.when(et == "click", amount + 500).alias("liquidation_threshold"),
        F.when(et == "click", k + 10000).alias("liquidation_bonus"),
        F.lit(None).cast("string").alias("strategy"),
        F.when(et == "error", dec(amount)).alias("liquidity_rate"),
        F.when(et == "error", dec(amount * 2)).alias("stable_borrow_rate"),
        F.when(et == "error", dec(amount * 3)).alias("variable_borrow_rate"),
        F.when(et == "error", dec(k + 1000000)).alias("liquidity_index"),
        F.when(et == "error", dec(k * 2 + 1000000)).alias("variable_borrow_index"),
    )


# ---------------------------------------------------------------- eMode

def fx_user_emode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> UserEModeSet events (user, category, block = day number)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                   "o_orderpriority")
    return o.select(
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
         .cast("bigint").alias("block_number"),
        F.col("o_orderkey").cast("bigint").alias("log_index"),
        address_of(F.col("o_custkey")).alias("user_address"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("category_id"),
    )


def fx_emode_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> per-asset eMode flag events (collateral / borrowable / ltvzero)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (F.when(F.col("event_type") == "click", "collateral")
            .when(F.col("event_type") == "view", "borrowable")
            .when(F.col("event_type") == "signup", "ltvzero"))
    return e.where(F.col("event_type").isin("click", "view", "signup")).select(
        *_event_clock(e),
        (k % 8).cast("int").alias("category_id"),
        address_of(asset_id(F.col("user_id") % N_ASSETS)).alias("asset"),
        kind.alias("bitmap"),
        (F.col("event_id") % 2 == 1).alias("flag"),
    )


def fx_emode_category_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events (purchase) -> EModeCategoryAdded events."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "props") \
        .where(F.col("event_type") == "purchase")
    k = F.get_json_object("props", "$.k").cast("bigint")
    cat = (k % 8).cast("int")
    return e.select(
        *_event_clock(e),
        cat.alias("category_id"),
        (F.lit(9000) + k).alias("ltv"),
        (F.lit(9300) + k).alias("liquidation_threshold"),
        (F.lit(10100) + k).alias("liquidation_bonus"),
        address_of(F.lit(5000) + cat).alias("oracle"),
        F.concat(F.lit("category-"), cat.cast("string"), F.lit("-v"),
                 (F.col("event_id") % 3).cast("string")).alias("label"),
    )


# ---------------------------------------------------------------- snapshots

def fx_position_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier x known reserves -> user_positions seed rows at (5000, -1)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    x = s.select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   F.lit(N_KNOWN_RESERVES - 1).cast("bigint"))).alias("r"))
    supply = ((F.col("s_suppkey") * 31 + F.col("r") * 17) % 1000 * 100).cast(D38)
    debt = ((F.col("s_suppkey") * 13 + F.col("r") * 29) % 700 * 100).cast(D38)
    idx = ray_index_of(F.col("r"))
    out = x.select(
        address_of(F.col("s_suppkey")).alias("user_address"),
        address_of(F.col("r")).alias("asset_address"),
        supply.alias("scaled_atoken_balance"),
        debt.alias("scaled_variable_debt"),
        ((F.col("s_suppkey") + F.col("r")) % 2 == 0).alias("use_as_collateral"),
        idx.alias("atoken_last_index"),
        idx.alias("debt_last_index"),
        F.lit(SNAPSHOT_BLOCK).cast("bigint").alias("last_updated_block"),
        F.lit(-1).cast("bigint").alias("last_updated_log_index"),
        F.lit(True).alias("is_active"),
        F.lit(SNAPSHOT_BLOCK).cast("bigint").alias("created_at_block"),
    )
    return out.where((F.col("scaled_atoken_balance") > 0) | (F.col("scaled_variable_debt") > 0))


def fx_snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position snapshot as paged JSON text, one page per supplier (<= 50 rows).

    Numbers travel as strings, as in the paged snapshot service; zero rows are
    included so the loader's filter has work to do.
    """
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    x = s.select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   F.lit(N_ASSETS - 1).cast("bigint"))).alias("r"))
    user = address_of(F.col("s_suppkey"))
    asset = address_of(asset_id(F.col("r")))
    idx = ray_index_of(F.col("r")).cast("string")
    item = F.struct(
        F.concat(user, asset).alias("id"),
        F.struct(user.alias("id")).alias("user"),
        F.struct(asset.alias("underlyingAsset"), idx.alias("liquidityIndex"),
                 idx.alias("variableBorrowIndex")).alias("reserve"),
        ((F.col("s_suppkey") * 31 + F.col("r") * 17) % 1000 * 100).cast("string")
        .alias("scaledATokenBalance"),
        ((F.col("s_suppkey") * 13 + F.col("r") * 29) % 700 * 100).cast("string")
        .alias("scaledVariableDebt"),
        ((F.col("s_suppkey") + F.col("r")) % 2 == 0).alias("usageAsCollateralEnabledOnUser"),
    )
    pages = x.groupBy("s_suppkey").agg(F.collect_list(item).alias("rows"))
    return pages.select(
        F.col("s_suppkey").alias("page"),
        F.to_json(F.struct(F.struct(F.col("rows").alias("userReserves")).alias("data")))
        .alias("body"))


def fx_contract_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events (click) -> contract view values by (entity, block) for as-of reads."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props") \
        .where(F.col("event_type") == "click")
    return e.select(
        (F.col("user_id") % 10).cast("int").alias("entity"),
        *_event_clock(e)[:2],
        F.get_json_object("props", "$.k").cast("bigint").alias("value"),
    )


def fx_read_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events (view) -> (entity, block) points at which the view value is wanted."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type") \
        .where(F.col("event_type") == "view")
    return e.select(
        F.col("event_id").alias("probe_id"),
        (F.col("user_id") % 10).cast("int").alias("entity"),
        *_event_clock(e)[:2],
    )


def fx_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations.text and documents.text as error-message input."""
    c = read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("message_id"),
        F.col("text").alias("message"))
    d = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("bigint").alias("message_id"),
        F.col("text").alias("message"))
    return c.unionByName(d)


def fx_reserve_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> contract reads at one block, one per part: of its reserve, or of the unlisted asset its key names.

    Columns mirror the reads of a reserve load: token addresses, configuration,
    caps, pool reserve data (packed configuration word), optional group and
    token supplies.  Every 7th asset has no optional group (read failed) and
    even assets have no stable debt token.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    r = F.col("p_partkey")
    asset = asset_id(r)
    dec = lambda c: c.cast(D38)
    paused = (r % 3 == 0)
    # configuration word: bit 60 = paused, low 16 bits = ltv
    cfg = F.concat(F.lit("0" * 48), F.when(paused, F.lit("1")).otherwise(F.lit("0")),
                   F.lit("00000000000"), F.lpad(F.lower(F.hex(F.lit(7000) + r)), 4, "0"))
    no_opt = (r % 7 == 0)
    return p.select(
        address_of(asset).alias("asset_address"),
        F.lit(SNAPSHOT_BLOCK).cast("bigint").alias("block_number"),
        F.when(r % 5 == 0, None).otherwise(F.col("p_name")).alias("symbol"),
        atoken_of(asset).alias("atoken_address"),
        debt_token_of(asset).alias("v_debt_token_address"),
        F.when(r % 2 == 0, F.lit("0x" + "0" * 40)).otherwise(address_of(F.lit(S_DEBT_BASE) + asset))
         .alias("s_debt_token_address"),
        address_of(F.lit(STRATEGY_BASE) + asset).alias("interest_rate_strategy_address"),
        F.col("p_size").cast("bigint").alias("decimals"),
        (F.lit(7000) + r).cast("bigint").alias("ltv"),
        (F.lit(7500) + r).cast("bigint").alias("liquidation_threshold"),
        (F.lit(10500) + r).cast("bigint").alias("liquidation_bonus"),
        F.lit(1000).cast("bigint").alias("reserve_factor"),
        (r % 4 != 1).alias("usage_as_collateral_enabled"),
        (r % 2 == 1).alias("borrowing_enabled"),
        F.lit(False).alias("stable_borrow_rate_enabled"),
        (r % 9 != 8).alias("is_active"),
        (r % 11 == 10).alias("is_frozen"),
        dec(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("supply_cap"),
        dec(F.round(F.col("p_retailprice") * 50).cast("bigint")).alias("borrow_cap"),
        cfg.alias("configuration"),
        r.cast("int").alias("reserve_id"),
        ray_index_of(r).alias("liquidity_index"),
        ray_index_of(r * 2).alias("variable_borrow_index"),
        dec(F.col("p_size") * 1000).alias("current_liquidity_rate"),
        dec(F.col("p_size") * 3000).alias("current_variable_borrow_rate"),
        dec(F.col("p_size") * 5000).alias("current_stable_borrow_rate"),
        dec(r * 11).alias("accrued_to_treasury"),
        dec(F.lit(0)).alias("unbacked"),
        dec(r * 13).alias("isolation_mode_total_debt"),
        F.when(no_opt, None).otherwise(r % 2 == 0).alias("flash_loan_enabled"),
        F.when(no_opt, None).otherwise(dec(r * 1000)).alias("debt_ceiling"),
        F.when(no_opt, None).otherwise(dec(r * 10)).alias("liquidation_protocol_fee"),
        F.when(no_opt, None).otherwise(r % 2 == 1).alias("siloed_borrowing"),
        F.when(no_opt, None).otherwise(dec(r * 100)).alias("unbacked_mint_cap"),
        dec(F.round(F.col("p_retailprice") * 1000).cast("bigint")).alias("atoken_total_supply"),
        dec(F.round(F.col("p_retailprice") * 400).cast("bigint")).alias("vdebt_total_supply"),
        dec(F.round(F.col("p_retailprice") * 7).cast("bigint")).alias("sdebt_total_supply"),
    )


# ---------------------------------------------------------------- raw encodings

_STORED: dict[tuple, DataFrame] = {}
BLOCK_BUCKET = 10_000  # blocks per bucket of the stored log tables


def block_bucket(block="block_number") -> Column:
    b = F.col(block) if isinstance(block, str) else block
    return F.floor(b / BLOCK_BUCKET).cast("bigint")


def materialize(df: DataFrame, key: tuple | None = None) -> DataFrame:
    """Write a derived fixture table once as parquet under the shared
    checkpoint folder and read it back, so later plans scan it like a stored
    log table (column pruning, filters on blocks pushed to the row groups)
    instead of re-deriving (and inlining) its encoding expressions.  Every task
    writes the rows it reads: no shuffle, no sort, and a block range that holds
    most logs is not one task's.  With a ``key`` the stored table is reused by
    later queries of the same session."""
    import os
    import uuid
    spark = df.sparkSession
    k = None
    if key is not None:
        k = (id(spark.sparkContext._jsc), *key)
        if k in _STORED:
            return _STORED[k]
    name = (key[0] if key else "table") + "-" + uuid.uuid4().hex[:12]
    path = os.path.join(checkpoint_dir(spark), "tables", name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    if k is not None:
        _STORED[k] = out
    return out


def _encode_token_events(ev: DataFrame) -> DataFrame:
    t = lambda name: F.lit(TOPIC[name])
    w = lambda a: F.concat(F.lit("0x"), address_to_word(a))
    topic0 = (F.when(F.col("event") == "Mint", t("Mint"))
              .when(F.col("event") == "Burn", t("Burn"))
              .when(F.col("event") == "BalanceTransfer", t("BalanceTransfer"))
              .when(F.col("event") == "ReserveUsedAsCollateralEnabled",
                    t("ReserveUsedAsCollateralEnabled"))
              .otherwise(t("ReserveUsedAsCollateralDisabled")))
    is_coll = F.col("reserve").isNotNull()
    topics = F.when(is_coll, F.array(topic0, w(F.col("reserve")), w(F.col("user_address")))) \
        .otherwise(F.array(topic0, w(F.col("from_address")), w(F.col("to_address"))))
    data = (F.when(is_coll, F.lit("0x"))
            .when(F.col("event") == "BalanceTransfer",
                  F.concat(F.lit("0x"), uint_to_word("value"), uint_to_word("idx")))
            .otherwise(F.concat(F.lit("0x"), uint_to_word("value"),
                                uint_to_word("balance_increase"), uint_to_word("idx"))))
    # ``let`` keeps this projection out of the stage's one method, which would be too long for the JVM to compile
    return ev.select("address", topics.alias("topics"), data.alias("data"), "block_number",
                     "log_index", "tx_hash", "arrival", let(block_bucket(), lambda b: b).alias("block_bucket"))


def _enc_word(col: Column, typ: str) -> Column:
    if typ == "address":
        return address_to_word(col)
    if typ == "bool":
        return uint_to_word(col.cast("int"))
    return uint_to_word(col)


def encode_logs(typed: DataFrame, emitter: Column, events: list[str]) -> DataFrame:
    """Typed events (``event`` + the decoder's field columns) -> raw logs.

    The inverse of :func:`tallyray.operators.decode.decode_logs`: indexed
    fields become topics, the others 32-byte data words; a string argument is
    an offset word plus a length-prefixed, zero-padded tail.
    """
    from ..operators.decode import SPECS
    ev = F.col("event")
    topics, data = None, None
    for name in events:
        spec = SPECS[name]
        tws = [F.lit(TOPIC[name])] + [
            F.concat(F.lit("0x"), _enc_word(F.col(f), t)) for f, loc, t in spec if loc[0] == "t"]
        words, tail = [], []
        n_static = sum(1 for _, loc, _ in spec if loc[0] == "w")
        for f, loc, t in spec:
            if loc[0] != "w":
                continue
            if t == "string":
                hx = F.lower(F.hex(F.encode(F.col(f), "UTF-8")))
                padded = F.rpad(hx, (F.ceil(F.length(hx) / 64) * 64).cast("int"), "0")
                words.append(uint_to_word(F.lit(32 * n_static)))
                tail += [uint_to_word(F.length(hx) / 2), padded]
            else:
                words.append(_enc_word(F.col(f), t))
        d = F.concat(F.lit("0x"), *words, *tail) if words else F.lit("0x")
        t_arr = F.array(*tws)
        topics = F.when(ev == name, t_arr) if topics is None else topics.when(ev == name, t_arr)
        data = F.when(ev == name, d) if data is None else data.when(ev == name, d)
    return typed.select(emitter.alias("address"), topics.alias("topics"), data.alias("data"),
                        "block_number", "log_index", "tx_hash")


def fx_raw_reserve_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration, eMode and user-eMode events encoded as raw logs."""
    cfg = fx_config_events(spark, sf_dir).withColumn("old_amount", F.lit(0).cast(D38))
    cfg_logs = encode_logs(cfg, F.when(F.col("event") == "ReserveDataUpdated", pool_address())
                           .otherwise(address_of(F.lit(POOL_ID + 1))),
                           ["SupplyCapChanged", "ReserveFrozen", "ReserveUnfrozen", "ReservePaused",
                            "CollateralConfigurationChanged", "ReserveDataUpdated"])
    em = fx_emode_assets(spark, sf_dir).select(
        "block_number", "log_index", "tx_hash", "asset", "category_id", "flag",
        F.when(F.col("bitmap") == "collateral", "AssetCollateralInEModeChanged")
         .when(F.col("bitmap") == "borrowable", "AssetBorrowableInEModeChanged")
         .otherwise("AssetLtvzeroInEModeChanged").alias("event"))
    # the same events row also drives a configuration event: shift the log index
    em = em.withColumn("log_index", F.col("log_index") + 1_000_000)
    em_logs = encode_logs(em, address_of(F.lit(POOL_ID + 1)),
                          ["AssetCollateralInEModeChanged", "AssetBorrowableInEModeChanged",
                           "AssetLtvzeroInEModeChanged"])
    cat = fx_emode_category_events(spark, sf_dir).withColumn("event", F.lit("EModeCategoryAdded")) \
        .withColumn("log_index", F.col("log_index") + 2_000_000)
    cat_logs = encode_logs(cat, address_of(F.lit(POOL_ID + 1)), ["EModeCategoryAdded"])
    ue = fx_user_emode(spark, sf_dir).withColumn("event", F.lit("UserEModeSet")) \
        .withColumn("tx_hash", tx_hash_of("log_index"))
    ue_logs = encode_logs(ue, pool_address(), ["UserEModeSet"])
    u = cfg_logs.unionByName(em_logs).unionByName(cat_logs).unionByName(ue_logs)
    return materialize(u.withColumn("block_bucket", block_bucket()), ("raw_reserve_logs", sf_dir))


def fx_raw_token_logs_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw token logs where quantity 50 loses its last data word and quantity
    49 loses its topics (degenerate deliveries for the reject path)."""
    ev = fx_token_events(spark, sf_dir)
    raw = _encode_token_events(ev)
    q = F.col("arrival.q")
    data = F.when((q == 50) & (F.length("data") > 2),
                  F.expr("substring(data, 1, length(data) - 64)")).otherwise(F.col("data"))
    topics = F.when(q == 49, F.array().cast("array<string>")).otherwise(F.col("topics"))
    out = raw.select("address", topics.alias("topics"), data.alias("data"), "block_number",
                     "log_index", "tx_hash", "arrival", "block_bucket")
    return materialize(out, ("raw_token_logs_with_faults", sf_dir))


def fx_raw_wide_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw token logs whose amounts leave 38 digits on every fifth asset.

    There an amount v becomes v * (2^128 + 1) and the index one ray; a Mint at
    log index 7 has index zero and a Burn at log index 6 the value 2^256 - 1,
    neither of which has a quotient.  All other assets keep their logs.
    """
    raw = _encode_token_events(fx_token_events(spark, sf_dir))
    doubled = lambda c: F.repeat(F.lpad(F.lower(F.hex(c)), 32, "0"), 2)
    t0, li = F.get("topics", 0), F.col("log_index")
    mint, burn, move = (t0 == TOPIC[n] for n in ("Mint", "Burn", "BalanceTransfer"))
    value = F.when(burn & (li == 6), F.lit("f" * 64)).otherwise(doubled(F.col("arrival.v")))
    idx = F.when(mint & (li == 7), F.lit("0" * 64)).otherwise(F.lit(f"{RAY:064x}"))
    data = F.when(move, F.concat(F.lit("0x"), value, idx)).when(
        mint | burn, F.concat(F.lit("0x"), value, doubled(F.col("arrival.i")), idx)).otherwise(F.col("data"))
    out = raw.withColumn("data", F.when(F.col("arrival.p") % 5 == 0, data).otherwise(F.col("data")))
    return materialize(out, ("raw_wide_logs", sf_dir))
