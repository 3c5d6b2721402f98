"""Latest-wins folds: reserve configuration, reserve rates, user eMode, eMode
categories and their asset bitmaps, and the snapshot merges.

Each guarded UPDATE of the reference becomes, in set form, a per-column
``max_by(value, ordkey)`` over the events newer than the seed row, computed in
ONE hash aggregation per table (map-side partial combine, one shuffle for all
columns), then left-joined back to the seed.  In chain order this equals the
row-level guard (every later event passes it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .joins import dim_join
from .order import asof_join, ord_block, ord_log, ordkey

# Event -> {reserves column: SQL expression over the decoded event}.
# ReserveStableRateBorrowing changes only the flag: its address update shares
# the flag's ordkey and never passes the strict guard.
RESERVE_UPDATES: dict[str, dict[str, str]] = {
    "ReserveFactorChanged": {"reserve_factor": "CAST(new_amount AS BIGINT)"},
    "SupplyCapChanged": {"supply_cap": "new_amount"},
    "BorrowCapChanged": {"borrow_cap": "new_amount"},
    "ReserveStableRateBorrowing": {"is_stable_borrow_enabled": "flag"},
    "CollateralConfigurationChanged": {"ltv": "ltv",
                                       "liquidation_threshold": "liquidation_threshold",
                                       "liquidation_bonus": "liquidation_bonus"},
    "ReserveFrozen": {"is_frozen": "true"},
    "ReserveUnfrozen": {"is_frozen": "false"},
    "ReservePaused": {"is_paused": "flag"},
    "ReserveBorrowing": {"is_borrowing_enabled": "flag"},
    "ReserveActive": {"is_active": "flag"},
    "ReserveDropped": {"is_dropped": "true", "is_active": "false"},
    "ReserveInterestRateStrategyChanged": {"interest_rate_strategy_address": "strategy"},
    "ReserveFlashLoaning": {"is_flash_loan_enabled": "flag"},
    "DebtCeilingChanged": {"debt_ceiling": "new_amount"},
    "LiquidationProtocolFeeChanged": {"liquidation_protocol_fee": "CAST(new_amount AS BIGINT)"},
    "SiloedBorrowingChanged": {"is_siloed_borrowing": "flag"},
    "UnbackedMintCapChanged": {"unbacked_mint_cap": "new_amount"},
}

STATE_UPDATES: dict[str, dict[str, str]] = {
    "ReserveDataUpdated": {"liquidity_index": "liquidity_index",
                           "variable_borrow_index": "variable_borrow_index",
                           "current_liquidity_rate": "liquidity_rate",
                           "current_variable_borrow_rate": "variable_borrow_rate",
                           "current_stable_borrow_rate": "stable_borrow_rate"},
}


def _pivot_updates(events: DataFrame, updates: dict[str, dict[str, str]],
                   seed: DataFrame, key_event: str, key_seed: str) -> tuple[DataFrame, list[str]]:
    """One row per event: (key, ok, col_1..col_n) with nulls for untouched columns."""
    targets: list[str] = []
    for m in updates.values():
        for c in m:
            if c not in targets and c in seed.columns:
                targets.append(c)
    updates = {n: {c: e for c, e in m.items() if c in targets} for n, m in updates.items()}
    updates = {n: m for n, m in updates.items() if m}
    ev = F.col("event")
    cols = []
    for c in targets:
        expr = None
        for name, m in updates.items():
            if c in m:
                v = F.expr(m[c]).cast(seed.schema[c].dataType)
                expr = F.when(ev == name, v) if expr is None else expr.when(ev == name, v)
        cols.append(expr.alias(c))
    piv = events.where(ev.isin(*updates.keys())).select(
        F.col(key_event).alias(key_seed), ordkey().alias("__ok"), *cols)
    return piv, targets


def latest_wins(events: DataFrame, seed: DataFrame, updates: dict[str, dict[str, str]],
                key_event: str = "asset", key_seed: str = "asset_address") -> DataFrame:
    """Guarded per-column fold of ``events`` onto ``seed`` rows.

    Events for keys missing from the seed are no-ops (see
    :func:`tallyray.operators.joins.missing_reserves`).  The seed's ordkey
    comes in through a checked-size dimension join, so the guard is applied
    before the aggregation.
    """
    piv, targets = _pivot_updates(events, updates, seed, key_event, key_seed)
    seed_ok = seed.select(F.col(key_seed).alias("__k"),
                          ordkey("last_updated_block", "last_updated_log_index").alias("__sok"))
    newer = dim_join(piv, seed_ok, F.col(key_seed) == F.col("__k"), "inner") \
        .where(F.col("__ok") > F.col("__sok")).drop("__k", "__sok")
    nn = lambda c: F.when(F.col(c).isNotNull(), F.col("__ok"))
    # string values are not mutable aggregation-buffer types: for them the
    # hash aggregate keeps only the winning ordkey, and the value is fetched
    # by a join on (key, ordkey); every other column uses max_by directly
    strings = [c for c in targets if isinstance(seed.schema[c].dataType, T.StringType)]
    agg = newer.groupBy(key_seed).agg(
        *[F.max_by(c, nn(c)).alias(f"__new_{c}") for c in targets if c not in strings],
        *[F.max(nn(c)).alias(f"__ok_{c}") for c in strings],
        F.max("__ok").alias("__last"))
    for c in strings:
        vals = newer.where(F.col(c).isNotNull()).select(
            F.col(key_seed).alias("__k"), F.col("__ok").alias(f"__ok_{c}"), F.col(c).alias(f"__new_{c}"))
        agg = agg.join(vals, (agg[key_seed] == vals["__k"]) & (agg[f"__ok_{c}"] == vals[f"__ok_{c}"]),
                       "left").drop("__k", f"__ok_{c}")
    j = seed.join(agg, key_seed, "left")
    out = []
    for c in seed.columns:
        if c in targets:
            out.append(F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c))
        elif c == "last_updated_block":
            out.append(F.coalesce(ord_block("__last"), F.col(c)).alias(c))
        elif c == "last_updated_log_index":
            out.append(F.coalesce(ord_log("__last"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def fold_reserves(events: DataFrame, reserves: DataFrame) -> DataFrame:
    return latest_wins(events, reserves, RESERVE_UPDATES)


def fold_reserve_state(events: DataFrame, state: DataFrame) -> DataFrame:
    return latest_wins(events, state, STATE_UPDATES)


def fold_user_emode(events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Insert-or-guarded-update per user: the newest (block, log) wins; a seed
    row is only replaced by strictly newer events."""
    ok = ordkey()
    ev = events.select("user_address", ok.alias("__ok"), F.col("category_id").cast("int").alias("c"))
    if seed is not None:
        s = seed.select("user_address", ordkey("last_updated_block", "last_updated_log_index")
                        .alias("__ok"), F.col("emode_category_id").cast("int").alias("c"))
        ev = ev.unionByName(s)
    agg = ev.groupBy("user_address").agg(F.max_by("c", "__ok").alias("emode_category_id"),
                                         F.max("__ok").alias("__last"))
    return agg.select("user_address", "emode_category_id",
                      ord_block("__last").alias("last_updated_block"),
                      ord_log("__last").alias("last_updated_log_index"))


def active_emode_users(user_emode: DataFrame) -> DataFrame:
    return user_emode.where(F.col("emode_category_id") > 0)


# ---------------------------------------------------------------- eMode

CATEGORY_COLS = ["ltv", "liquidation_threshold", "liquidation_bonus", "oracle", "label"]


def fold_categories(category_events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Unguarded full-row overwrite: in chain order the newest event's row wins."""
    ok = ordkey()
    ev = category_events.select("category_id", ok.alias("__ok"),
                                F.struct(*CATEGORY_COLS).alias("__row"))
    if seed is not None:
        ev = ev.unionByName(seed.select(
            "category_id", ordkey("last_updated_block", "last_updated_log_index").alias("__ok"),
            F.struct(*CATEGORY_COLS).alias("__row")))
    agg = ev.groupBy("category_id").agg(F.max_by("__row", "__ok").alias("__r"),
                                        F.max("__ok").alias("__last"))
    return agg.select("category_id", *[F.col("__r").getField(c).alias(c) for c in CATEGORY_COLS],
                      ord_block("__last").alias("last_updated_block"),
                      ord_log("__last").alias("last_updated_log_index"))


BITMAPS = {"AssetCollateralInEModeChanged": "collateral",
           "AssetBorrowableInEModeChanged": "borrowable",
           "AssetLtvzeroInEModeChanged": "ltvzero"}


def _named_bitmaps(flag_events: DataFrame) -> DataFrame:
    if "bitmap" in flag_events.columns:
        return flag_events
    return flag_events.withColumn("bitmap", F.create_map(*[x for kv in BITMAPS.items()
                                                             for x in map(F.lit, kv)])[F.col("event")])


def asset_flags(flag_events: DataFrame) -> DataFrame:
    """Latest flag per (category, asset, bitmap), chain order."""
    return _named_bitmaps(flag_events).groupBy("category_id", "asset", "bitmap").agg(
        F.max_by("flag", ordkey()).alias("flag"))


def fold_bitmaps(flag_events: DataFrame, reserves: DataFrame) -> DataFrame:
    """Per category: the three 128-bit bitmaps (bit = reserve_id) as 32-digit
    hex text plus member counts.  Members whose asset has no reserve id are
    ignored (the contract keys bitmaps by id).  A category whose flags are all
    cleared keeps its row, with bitmaps 0."""
    flags = asset_flags(flag_events)
    ids = reserves.select(F.col("asset_address").alias("asset"), "reserve_id") \
        .where(F.col("reserve_id").isNotNull() & (F.col("reserve_id") < 128))
    m = dim_join(flags, ids, "asset", "inner")
    lo = F.expr("CASE WHEN flag AND reserve_id < 64 THEN shiftleft(CAST(1 AS BIGINT), reserve_id) END")
    hi = F.expr("CASE WHEN flag AND reserve_id >= 64 THEN shiftleft(CAST(1 AS BIGINT), reserve_id - 64) END")
    agg = m.groupBy("category_id").pivot("bitmap", ["collateral", "borrowable", "ltvzero"]).agg(
        F.bit_or(lo).alias("lo"), F.bit_or(hi).alias("hi"), F.count_if("flag").alias("n"))
    hexw = lambda c: F.lpad(F.lower(F.hex(F.coalesce(F.col(c), F.lit(0).cast("bigint")))), 16, "0")
    out = [F.col("category_id")]
    for b in ["collateral", "borrowable", "ltvzero"]:
        out.append(F.concat(F.lit("0x"), hexw(f"{b}_hi"), hexw(f"{b}_lo")).alias(f"{b}_bitmap"))
        out.append(F.coalesce(F.col(f"{b}_n"), F.lit(0)).cast("bigint").alias(f"{b}_members"))
    return agg.select(*out)


def bitmap_members(flag_events: DataFrame, reserves: DataFrame) -> DataFrame:
    """(category, bitmap, reserve_id) rows for every set bit of the 128."""
    flags = asset_flags(flag_events).where(F.col("flag"))
    ids = reserves.select(F.col("asset_address").alias("asset"), "reserve_id") \
        .where(F.col("reserve_id").isNotNull() & (F.col("reserve_id") < 128))
    return dim_join(flags, ids, "asset", "inner").select("category_id", "bitmap", "reserve_id")


WORD_BITS, N_WORDS = 32, 4


def bitmap_history(flag_events: DataFrame, reserves: DataFrame, bucket_blocks: int = 10_000) -> DataFrame:
    """The three bitmaps of every category after each block that changes one of them.

    A bitmap is a running sum: a flag that turns a member on adds its bit, one
    that turns it off takes it away, a repeated flag adds nothing.  Only the
    last flag of a member in a block counts.  The 128 bits are four words of 32
    bits, so sums stay exact longs.  Time is cut into buckets of
    ``bucket_blocks``; a bucket's first flags and sums continue from a table
    with one row per (member, bucket) or (category, bucket), so that a hot
    category or member is spread over its buckets.

    Columns: category_id, block_number, log_index (0), ``<bitmap>_<word>``.
    Assets without a reserve id below 128 are ignored, as in :func:`fold_bitmaps`.
    """
    ids = reserves.select(F.col("asset_address").alias("asset"), "reserve_id") \
        .where(F.col("reserve_id").isNotNull() & (F.col("reserve_id") < WORD_BITS * N_WORDS))
    member = ["category_id", "bitmap", "reserve_id"]
    bkt = F.floor(F.col("block_number") / bucket_blocks).cast("bigint").alias("bkt")
    per_block = dim_join(_named_bitmaps(flag_events), ids, "asset", "inner") \
        .groupBy(*member, "block_number").agg(F.max_by("flag", ordkey()).alias("flag")).select("*", bkt)
    in_bucket = Window.partitionBy(*member, "bkt").orderBy("block_number")
    last = per_block.groupBy(*member, "bkt").agg(F.max_by("flag", "block_number").alias("last"))
    carry = last.select(*member, "bkt", F.lag("last").over(Window.partitionBy(*member).orderBy("bkt")).alias("carry"))
    turned = per_block.withColumn("before", F.lag("flag").over(in_bucket)).join(carry, [*member, "bkt"])
    sign = F.col("flag").cast("bigint") - F.coalesce("before", "carry", F.lit(False)).cast("bigint")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(reserve_id % {WORD_BITS} AS INT))")
    words = {f"{b}_{k}": F.sum(F.when((F.col("bitmap") == b) & (F.floor(F.col("reserve_id") / WORD_BITS) == k), sign * bit)
                               .otherwise(F.lit(0).cast("bigint"))) for b in BITMAPS.values() for k in range(N_WORDS)}
    steps = turned.groupBy("category_id", "block_number", "bkt").agg(*[x.alias(c) for c, x in words.items()])
    totals = steps.groupBy("category_id", "bkt").agg(*[F.sum(c).alias(c) for c in words])
    earlier = Window.partitionBy("category_id").orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("category_id", "bkt", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in words])
    upto = Window.partitionBy("category_id", "bkt").orderBy("block_number").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("category_id", "bkt", "block_number", *[F.sum(c).over(upto).alias(c) for c in words])
    return sums.join(offsets, ["category_id", "bkt"]).select(
        "category_id", "block_number", F.lit(0).cast("bigint").alias("log_index"),
        *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in words])


def bitmaps_as_of(probes: DataFrame, flag_events: DataFrame, reserves: DataFrame,
                  bucket_blocks: int = 10_000) -> DataFrame:
    """``probes`` (category_id, block_number, ...) with the category's three
    bitmaps as of the end of that block, as 32-digit hex text, and their member
    counts; all zero before the first flag."""
    words = [f"{b}_{k}" for b in BITMAPS.values() for k in range(N_WORDS)]
    j = asof_join(probes, bitmap_history(flag_events, reserves, bucket_blocks), "category_id", words,
                  bucket_blocks=bucket_blocks)
    word = lambda b, k: F.coalesce(F.col(f"{b}_{k}"), F.lit(0))
    out = []
    for b in BITMAPS.values():
        parts = [F.lpad(F.lower(F.hex(word(b, k))), WORD_BITS // 4, "0") for k in reversed(range(N_WORDS))]
        out.append(F.concat(F.lit("0x"), *parts).alias(f"{b}_bitmap"))
        out.append(sum((F.bit_count(word(b, k)) for k in range(1, N_WORDS)), F.bit_count(word(b, 0))).cast("bigint")
                   .alias(f"{b}_members"))
    return j.select(*probes.columns, *out)


def emode_categories(category_events: DataFrame, flag_events: DataFrame,
                     reserves: DataFrame) -> DataFrame:
    """The ``emode_categories`` table: folded rows plus bitmaps.  Bitmap writes
    never touch ``last_updated_*``."""
    cats = fold_categories(category_events)
    bm = fold_bitmaps(flag_events, reserves)
    return cats.join(bm, "category_id", "left")


# ---------------------------------------------------------------- merges

def merge_overwrite(existing: DataFrame, incoming: DataFrame, key: str = "asset_address",
                    keep: tuple[str, ...] = ("last_updated_block", "last_updated_log_index")) -> DataFrame:
    """Insert or overwrite every column except ``keep`` (which an existing
    row retains).  A full outer join with ``coalesce(new, old)``."""
    e = existing.select(*[F.col(c).alias(f"__o_{c}") for c in existing.columns])
    n = incoming.select(*[F.col(c).alias(f"__n_{c}") for c in existing.columns])
    j = e.join(n, F.col(f"__o_{key}") == F.col(f"__n_{key}"), "full_outer")
    exists = F.col(f"__o_{key}").isNotNull()
    new = F.col(f"__n_{key}").isNotNull()
    out = []
    for c in existing.columns:
        if c in keep:
            out.append(F.when(exists, F.col(f"__o_{c}")).otherwise(F.col(f"__n_{c}")).alias(c))
        else:
            out.append(F.when(new, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c))
    return j.select(*out)


def heal_missing(events: DataFrame, seed: DataFrame, reads_rows: DataFrame,
                 key_event: str = "asset", key_seed: str = "asset_address") -> DataFrame:
    """Seed rows for keys that events reference but the seed lacks: the row
    loaded from contract reads as of the first event's block, stamped
    ``(first_block, -1)`` so that event and every later one pass the guard.
    ``reads_rows`` holds already-shaped seed rows with their read block in
    ``last_updated_block``."""
    first = events.join(seed.select(F.col(key_seed).alias(key_event)), key_event, "left_anti") \
        .groupBy(F.col(key_event).alias("__k")).agg(F.min("block_number").alias("__first"))
    r = reads_rows.select(*[F.col(c).alias(f"__r_{c}") for c in seed.columns])
    cand = first.join(r, F.col("__k") == F.col(f"__r_{key_seed}"), "inner") \
        .where(F.col("__r_last_updated_block") <= F.col("__first"))
    # as-of: the latest read at or before the first event's block
    best = cand.groupBy("__k", "__first").agg(
        F.max_by(F.struct(*[F.col(f"__r_{c}").alias(c) for c in seed.columns]),
                 F.col("__r_last_updated_block")).alias("__b"))
    out = []
    for c in seed.columns:
        if c == "last_updated_block":
            out.append(F.col("__first").alias(c))
        elif c == "last_updated_log_index":
            out.append(F.lit(-1).cast("bigint").alias(c))
        else:
            out.append(F.col("__b").getField(c).alias(c))
    return best.select(*out)
