"""Snapshot loaders: contract reads -> reserves / reserve_state rows, eMode
category arrays -> rows, paged position JSON -> user_positions rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import ZERO_ADDRESS, normalize_address
from ..functions.words import D38, config_bit
from ..operators.folds import fold_categories

PAUSED_BIT = 60

# The optional read group falls back to these five values together.
OPTIONAL_DEFAULTS = {"is_flash_loan_enabled": True, "debt_ceiling": 0,
                     "liquidation_protocol_fee": 0, "is_siloed_borrowing": False,
                     "unbacked_mint_cap": 0}
UNKNOWN_SYMBOL = "UNKNOWN"


def load_reserve_snapshot(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-asset reads at one block -> (reserves rows, reserve_state rows), both
    at ordkey (block, -1)."""
    opt_missing = F.col("flash_loan_enabled").isNull()
    dflt = lambda name, col, typ: F.when(opt_missing, F.lit(OPTIONAL_DEFAULTS[name]).cast(typ)) \
        .otherwise(F.col(col).cast(typ)).alias(name)
    stable_supply = F.when(F.col("s_debt_token_address") == F.lit(ZERO_ADDRESS), F.lit(0).cast(D38)) \
        .otherwise(F.coalesce(F.col("sdebt_total_supply"), F.lit(0).cast(D38)))
    reserves = reads.select(
        normalize_address("asset_address").alias("asset_address"),
        F.coalesce("symbol", F.lit(UNKNOWN_SYMBOL)).alias("symbol"),
        "decimals", "reserve_id", "ltv", "liquidation_threshold", "liquidation_bonus",
        "is_active", "is_frozen", config_bit(F.col("configuration"), PAUSED_BIT).alias("is_paused"),
        F.col("borrowing_enabled").alias("is_borrowing_enabled"),
        F.lit(False).alias("is_dropped"),
        "supply_cap", "borrow_cap", "reserve_factor",
        F.col("usage_as_collateral_enabled").alias("is_collateral_enabled"),
        F.col("stable_borrow_rate_enabled").alias("is_stable_borrow_enabled"),
        dflt("is_flash_loan_enabled", "flash_loan_enabled", "boolean"),
        dflt("debt_ceiling", "debt_ceiling", D38),
        dflt("liquidation_protocol_fee", "liquidation_protocol_fee", "bigint"),
        dflt("is_siloed_borrowing", "siloed_borrowing", "boolean"),
        dflt("unbacked_mint_cap", "unbacked_mint_cap", D38),
        normalize_address("atoken_address").alias("atoken_address"),
        normalize_address("v_debt_token_address").alias("v_debt_token_address"),
        normalize_address("s_debt_token_address").alias("s_debt_token_address"),
        normalize_address("interest_rate_strategy_address").alias("interest_rate_strategy_address"),
        F.col("block_number").alias("last_updated_block"),
        F.lit(-1).cast("bigint").alias("last_updated_log_index"))
    state = reads.select(
        normalize_address("asset_address").alias("asset_address"),
        "liquidity_index", "variable_borrow_index", "current_liquidity_rate",
        "current_variable_borrow_rate", "current_stable_borrow_rate",
        F.col("atoken_total_supply").alias("total_liquidity"),
        F.col("vdebt_total_supply").alias("total_variable_debt"),
        stable_supply.alias("total_stable_debt"),
        "accrued_to_treasury", "unbacked", "isolation_mode_total_debt",
        F.col("block_number").alias("last_updated_block"),
        F.lit(-1).cast("bigint").alias("last_updated_log_index"))
    return reserves, state


def load_emode_snapshot(reads: DataFrame) -> DataFrame:
    """Rows of ``emodes: array<struct<id, ltv, liquidation_threshold,
    liquidation_bonus, oracle, label>>`` -> category rows (latest read wins)."""
    x = reads.select("block_number", "log_index", F.explode("emodes").alias("e"))
    ev = x.select("block_number", "log_index", F.col("e.id").cast("int").alias("category_id"),
                  *[F.col(f"e.{c}").alias(c) for c in
                    ["ltv", "liquidation_threshold", "liquidation_bonus", "oracle", "label"]])
    return fold_categories(ev)


SNAPSHOT_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("reserve", T.StructType([
        T.StructField("underlyingAsset", T.StringType()),
        T.StructField("liquidityIndex", T.StringType()),
        T.StructField("variableBorrowIndex", T.StringType())])),
    T.StructField("scaledATokenBalance", T.StringType()),
    T.StructField("scaledVariableDebt", T.StringType()),
    T.StructField("usageAsCollateralEnabledOnUser", T.BooleanType()),
])
SNAPSHOT_PAGE = T.StructType([
    T.StructField("data", T.StructType([T.StructField("userReserves", T.ArrayType(SNAPSHOT_ROW))])),
    T.StructField("errors", T.ArrayType(T.StructType([T.StructField("message", T.StringType())]))),
])


def snapshot_rows(pages: DataFrame, body_col: str = "body") -> DataFrame:
    """Typed, exploded snapshot rows (explicit schema, numbers parsed exactly)."""
    p = pages.select(F.from_json(F.col(body_col), SNAPSHOT_PAGE).alias("p"))
    x = p.select(F.explode("p.data.userReserves").alias("r"))
    # Whole numbers of up to 38 digits are exact; anything else is null, and so a reject.
    num = lambda c: F.expr(f"CASE WHEN {c} RLIKE '^[0-9]+$' THEN try_cast({c} AS DECIMAL(38,0)) END")
    return x.select(
        F.col("r.id").alias("id"),
        normalize_address(F.col("r.user.id")).alias("user_address"),
        normalize_address(F.col("r.reserve.underlyingAsset")).alias("asset_address"),
        num("r.scaledATokenBalance").alias("scaled_atoken_balance"),
        num("r.scaledVariableDebt").alias("scaled_variable_debt"),
        F.col("r.usageAsCollateralEnabledOnUser").alias("use_as_collateral"),
        num("r.reserve.liquidityIndex").alias("atoken_last_index"),
        num("r.reserve.variableBorrowIndex").alias("debt_last_index"))


def _unparsable():
    """A row without a usable address, balance or index; each such row is one reject."""
    cols = ["user_address", "asset_address", "scaled_atoken_balance", "scaled_variable_debt", "atoken_last_index", "debt_last_index"]
    return reduce(or_, [F.col(c).isNull() for c in cols])


def load_position_snapshot(pages: DataFrame, at_block: int) -> DataFrame:
    """Positions with supply > 0 or debt > 0 as ``user_positions`` rows at (at_block, -1)."""
    r = snapshot_rows(pages)
    nz = r.where(~_unparsable()).where((F.col("scaled_atoken_balance") > 0) | (F.col("scaled_variable_debt") > 0))
    return nz.select(
        "user_address", "asset_address", "scaled_atoken_balance", "scaled_variable_debt",
        "use_as_collateral", "atoken_last_index", "debt_last_index",
        F.lit(at_block).cast("bigint").alias("last_updated_block"),
        F.lit(-1).cast("bigint").alias("last_updated_log_index"),
        ((F.col("scaled_atoken_balance") > 0) | (F.col("scaled_variable_debt") > 0)).alias("is_active"),
        F.lit(at_block).cast("bigint").alias("created_at_block"))


def snapshot_rejects(pages: DataFrame, reserves: DataFrame) -> DataFrame:
    """Snapshot rows that cannot be inserted: unparsable fields, or an asset
    that is not a known reserve (a foreign-key violation)."""
    r = snapshot_rows(pages)
    bad = r.where(_unparsable()).select("id", F.lit("unparsable").alias("reason"))
    nz = r.where(~_unparsable()).where((F.col("scaled_atoken_balance") > 0) | (F.col("scaled_variable_debt") > 0))
    orphan = nz.join(reserves.select("asset_address"), "asset_address", "left_anti") \
        .select("id", F.lit("unknown_reserve").alias("reason"))
    return bad.unionByName(orphan)
