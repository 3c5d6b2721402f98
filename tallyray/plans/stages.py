"""Reusable stages over the fixture tables (scan -> dedup -> route ->
resolve -> legs).  Every stage is lazy; Catalyst sees one plan per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import delivery_tasks, first_delivery
from ..operators.joins import MAX_BROADCAST_ROWS, emitters, fits_broadcast, resolve_token, token_map
from ..operators.positions import kept_legs, legs_from_events
from ..sources import fixtures as fx

TOKEN_EVENTS = ("Mint", "Burn", "BalanceTransfer")
COLLATERAL_EVENTS = ("ReserveUsedAsCollateralEnabled", "ReserveUsedAsCollateralDisabled")


def delivered_token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and collateral events, one copy per (tx_hash, log_index)."""
    ev, keys = fx.fx_token_events(spark, sf_dir), ("tx_hash", "log_index")
    return first_delivery(ev, keys, order="arrival", tasks=delivery_tasks(ev, keys)).drop("arrival")


def event_tokens(spark: SparkSession, sf_dir: str, events: DataFrame | None) -> DataFrame:
    """The token map; when reserves are many, only of the emitters of the token logs (of ``events`` from elsewhere: of all)."""
    reserves = fx.fx_reserves(spark, sf_dir)
    many = events is None and not fits_broadcast(reserves, MAX_BROADCAST_ROWS // 2)  # two tokens a reserve
    return token_map(reserves, emitters(fx.fx_token_events(spark, sf_dir)) if many else None)


def resolved_token_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = events if events is not None else delivered_token_events(spark, sf_dir)
    tm = event_tokens(spark, sf_dir, events)
    return resolve_token(ev.where(F.col("event").isin(*TOKEN_EVENTS)), tm)


def ledger_legs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return kept_legs(all_legs(spark, sf_dir, events))


def all_legs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Legs with their faults: those without an amount are still there."""
    ev = events if events is not None else delivered_token_events(spark, sf_dir)
    return legs_from_events(ev, event_tokens(spark, sf_dir, events))
