"""Dimension joins: token resolution, existence checks, foreign keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import normalize_address
from ..session import stored

# A dimension is broadcast only after its row count was checked against this
# bound; above it the join is left to the planner (sort-merge, AQE may still
# switch to broadcast from measured sizes).
MAX_BROADCAST_ROWS = 200_000


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Bounded check: counts at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
             max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join a fact table with a dimension, broadcasting the dimension only when
    its size was checked; otherwise a regular shuffled join."""
    side = F.broadcast(dim) if fits_broadcast(dim, max_rows) else dim
    return fact.join(side, on, how)


def emitters(events: DataFrame, address_col: str = "address") -> DataFrame:
    """The distinct addresses that sent ``events`` (column ``token``), stored: they are read several times."""
    return stored(events.select(F.col(address_col).alias("token")).where(F.col("token").isNotNull()).distinct(), "emitters")


def token_map(reserves: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Unpivot reserves to (token, asset_address, token_type).

    Unparsable token addresses are dropped.  When one token address appears as
    both an aToken and a debt token, the debt entry wins (it is written last
    for a reserve); the choice is made by a per-token aggregate.

    ``seen`` (:func:`emitters`) leaves the tokens that sent an event: with many
    reserves listed and few of them used the map stays small enough to
    broadcast, and the events are not shuffled by their (few) addresses.
    """
    a = reserves.select(normalize_address("atoken_address").alias("token"), "asset_address",
                        F.lit("atoken").alias("token_type"), F.lit(0).alias("__prio"))
    d = reserves.select(normalize_address("v_debt_token_address").alias("token"), "asset_address",
                        F.lit("vdebt").alias("token_type"), F.lit(1).alias("__prio"))
    u = a.unionByName(d).where(F.col("token").isNotNull())
    if seen is not None:
        u = dim_join(u, seen, "token", "left_semi")
    best = u.groupBy("token").agg(F.max(F.struct("__prio", "asset_address", "token_type")).alias("__b"))
    return best.select("token", F.col("__b.asset_address").alias("asset_address"),
                       F.col("__b.token_type").alias("token_type"))


def tracked_addresses(reserves: DataFrame, fixed: Sequence[str] = ()) -> DataFrame:
    """Every aToken and debt-token address of ``reserves`` plus fixed contracts."""
    toks = reserves.select(F.explode(F.array(normalize_address("atoken_address"),
                                             normalize_address("v_debt_token_address")))
                           .alias("address")).where(F.col("address").isNotNull())
    if fixed:
        spark = reserves.sparkSession
        toks = toks.unionByName(spark.createDataFrame([(a.lower(),) for a in fixed], "address string"))
    return toks.distinct()


def resolve_token(events: DataFrame, tmap: DataFrame, address_col: str = "address") -> DataFrame:
    """emitter -> (asset_address, token_type); events of unknown emitters drop out."""
    t = tmap.withColumnRenamed("token", "__token")
    j = dim_join(events, t, F.col(address_col) == F.col("__token"), "inner")
    return j.drop("__token")


def known_reserves(df: DataFrame, reserves: DataFrame, asset_col: str = "asset") -> DataFrame:
    keys = reserves.select(F.col("asset_address").alias("__a"))
    return dim_join(df, keys, F.col(asset_col) == F.col("__a"), "left_semi")


def unknown_reserves(df: DataFrame, reserves: DataFrame, asset_col: str = "asset") -> DataFrame:
    keys = reserves.select(F.col("asset_address").alias("__a"))
    return dim_join(df, keys, F.col(asset_col) == F.col("__a"), "left_anti")


def missing_reserves(events: DataFrame, reserves: DataFrame, asset_col: str = "asset",
                     block_col: str = "block_number", event_col: str = "event") -> DataFrame:
    """Assets referenced by reserve events (other than initialisation) that are
    not in ``reserves``, with the first block that needs them."""
    ev = events.where(F.col(event_col) != "ReserveInitialized")
    miss = unknown_reserves(ev, reserves, asset_col)
    return miss.groupBy(F.col(asset_col).alias("asset_address")).agg(
        F.min(block_col).alias("first_block"), F.count(F.lit(1)).alias("n_events"))


def orphan_check(child: DataFrame, parent: DataFrame, key: str = "asset_address") -> DataFrame:
    """Rows of ``child`` whose ``key`` has no parent row (a foreign-key check)."""
    return child.join(parent.select(key), key, "left_anti")
