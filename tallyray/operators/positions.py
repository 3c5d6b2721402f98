"""The position ledger: token events -> signed legs -> folded user positions.

Sequential semantics being reproduced (per (user, asset), in chain order):

* an *up* leg (supply or debt increase) inserts the row when it is missing
  (balance = delta, other side 0, collateral false, active, created = block)
  or, when the strict guard passes, adds its delta, sets its index and marks
  the row active;
* decreases and collateral toggles are guarded updates and never insert;
* the *clear* step after a burn / transfer-out is unguarded: supply <= 0
  clears collateral, and supply <= 0 with debt <= 0 marks the row inactive;
* the receiving leg of a self-transfer fails the guard once the row exists.

Set form (one shuffle of the legs on ``(user, asset)``, for pairs of at most
``HOT_LEGS`` legs): one window in chain order gives the creation, the running
balances and the flag events of every leg, and the pair's totals need no other
shuffle.

A pair with more legs (a pool or treasury account) goes by the block bucket, as
does one whose seed row is repeated (two shuffles on ``(user, asset, bucket)``;
this part of the plan is built only when there is such a pair):

1. running sums of the deltas inside each (user, asset, bucket) window;
2. per-bucket aggregates: first up leg, balance before it, totals;
3. per-pair window over *buckets* (small): creation ordkey, offsets of
   earlier buckets, seed values;
4. join back on (user, asset, bucket) -- the leg side is already partitioned
   by those keys -- to get each leg's running balance and its flag events;
5. ``max_by`` per pair (map-side combine) and a merge with the seed rows.

A hot pair is therefore spread over its block buckets instead of landing in a
single task.

Amounts: a leg whose delta stays below 10^27 is *narrow*, one decimal(38,0);
10^11 of them sum without overflow.  Any other leg is *wide*: its exact delta
and index travel as limbs (:mod:`tallyray.functions.uint256`) in the ``wide``
column, null on narrow legs.  A pair with a wide leg is folded by the same plan
over limb sums, all others over single decimals; both come from one pass over
the legs.  An amount without a quotient (index zero, or beyond 256 bits) has a
``fault`` and goes to :func:`ledger_rejects`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import uint256 as u256
from ..functions.raymath import with_ray_div
from ..functions.words import D38, dlit
from ..session import stored, tasks_for
from .order import ord_block, ord_log, ordkey

KEY = ["user_address", "asset_address"]
DEFAULT_BUCKET_BLOCKS = 10_000
HOT_LEGS = 100_000  # a pair with more legs is spread over its block buckets

NARROW = 10 ** 27
CALM = 10 ** 36  # operands below this never overflow 38 digits

LEG_FIELDS = ["user_address", "leg", "d_supply", "d_debt", "s_index", "d_index",
              "is_up", "clear", "toggle", "is_self", "wide", "fault"]
WIDE_FIELDS = ["d_supply", "d_debt", "s_index", "d_index"]
WIDE = "struct<" + ",".join(f"{c}:{u256.LIMBS}" for c in WIDE_FIELDS) + ">"
COLLATERAL_EVENTS = ("ReserveUsedAsCollateralEnabled", "ReserveUsedAsCollateralDisabled")
TOKEN_EVENTS = ("Mint", "Burn", "BalanceTransfer")


class Narrow:
    """Amounts as one decimal(38,0)."""

    @staticmethod
    def zero() -> Column:
        return dlit(0)

    @staticmethod
    def total(*terms) -> Column:
        acc = None
        for sign, x in terms:
            acc = (x if sign > 0 else dlit(0) - x) if acc is None else acc + x if sign > 0 else acc - x
        return acc.cast(D38)

    @staticmethod
    def summed(x: Column, window=None) -> Column:
        total = F.sum(x)
        return F.coalesce(total if window is None else total.over(window), dlit(0)).cast(D38)

    @staticmethod
    def nonpositive(x) -> Column:
        return x <= 0

    @staticmethod
    def of_seed(x) -> Column:
        return x.try_cast(D38)


class Wide:
    """Amounts as normalised limbs; sums are sums per limb."""

    @staticmethod
    def zero() -> Column:
        return u256.constant(0)

    total = staticmethod(u256.total)

    @staticmethod
    def summed(x: Column, window=None) -> Column:
        parts = [F.sum(x[k]) for k in "hml"]
        return u256.carried(*[F.coalesce(p if window is None else p.over(window), dlit(0)) for p in parts])

    @staticmethod
    def nonpositive(x) -> Column:
        return u256.is_negative(x) | u256.is_zero(x)

    @staticmethod
    def of_seed(x) -> Column:
        return u256.of_text(x.cast("string"))


def _with_deltas(events: DataFrame) -> DataFrame:
    """Each token event's scaled delta: ``__d`` when narrow, else the limbs ``__w``; ``__iw`` the index as limbs when it
    or the delta is wide; ``__fault`` when there is no delta.

    ``exact`` (struct of limbs value, balance_increase, idx; null or absent when all fit) comes from the decoder.
    """
    ev = F.col("event")
    v, b, i = F.col("value"), F.col("balance_increase"), F.col("idx")
    limbs = {c: u256.of_decimal(c) for c in ("value", "balance_increase", "idx")}
    calm = (F.coalesce(v, dlit(CALM)) < dlit(CALM)) & (F.coalesce(b, dlit(0)) < dlit(CALM))
    if "exact" in events.columns:
        limbs = {c: F.coalesce(F.col("exact")[c], x) for c, x in limbs.items()}
        calm = calm & F.col("exact").isNull()
    v38, b38 = v.cast(D38), b.cast(D38)
    size = F.when(calm, F.when(ev == "Mint", F.when(v38 >= b38, v38 - b38).otherwise(b38 - v38)).when(ev == "Burn", v38 + b38))
    out = with_ray_div(events, size.cast(D38), i, "__q0")
    delta = F.when(calm, F.when(ev == "Mint", F.when(v38 >= b38, F.col("__q0")).otherwise(dlit(0) - F.col("__q0")))
                   .when(ev == "Burn", dlit(0) - F.col("__q0")).when(ev == "BalanceTransfer", v)).cast(D38)
    out = out.withColumn("__d0", delta).drop("__q0")
    small = F.coalesce((F.col("__d0") < dlit(NARROW)) & (F.col("__d0") > dlit(-NARROW)), F.lit(False))
    wide = ev.isin(*TOKEN_EVENTS) & ~small
    out = out.withColumn("__x", F.when(wide, F.struct(*[x.alias(c) for c, x in limbs.items()])))
    x = F.col("__x")
    zero = u256.constant(0)

    def signed(args: Column) -> Column:
        amount = F.when(ev == "Burn", u256.total((1, args["value"]), (1, args["balance_increase"]))).otherwise(
            u256.total((1, args["value"]), (-1, args["balance_increase"])))

        def scaled(a: Column) -> Column:
            down = (ev == "Burn") | u256.is_negative(a)
            size = u256.magnitude(a)
            q = u256.let(u256.ray_div(size, args["idx"]), lambda y: F.when(down, u256.total((1, zero), (-1, y))).otherwise(y))
            return F.struct(q.alias("w"), u256.ray_div_fault(size, args["idx"]).alias("fault"))

        return u256.let(amount, scaled)

    plain = F.struct(x["value"].alias("w"), F.lit(None).cast("string").alias("fault"))
    got = F.when(x.isNotNull(), F.when(ev == "BalanceTransfer", plain).otherwise(u256.let(x, signed)))
    out = out.withColumn("__y", got)
    return out.select(*events.columns, F.when(x.isNull(), F.col("__d0")).alias("__d"), F.col("__y")["w"].alias("__w"),
                      x["idx"].alias("__iw"), F.col("__y")["fault"].alias("__fault"))


def _leg(user, leg, side=None, sign=1, idx=False, is_up=False, clear=None, toggle=None, is_self=None) -> Column:
    """One leg: the event's delta (times ``sign``) on the supply ('s') or debt ('d') side."""
    d, w = F.col("__d"), F.col("__w")
    none = F.lit(None).cast(u256.LIMBS)
    if sign < 0:
        d, w = dlit(0) - d, F.when(w.isNotNull(), u256.total((1, u256.constant(0)), (-1, w)))
    own = {"d_supply": side == "s", "d_debt": side == "d", "s_index": side == "s" and idx, "d_index": side == "d" and idx}
    zero = u256.constant(0)
    wide = F.struct(*[(w if own[c] else zero).alias(c) for c in ("d_supply", "d_debt")],
                    *[(F.col("__iw") if own[c] else none).alias(c) for c in ("s_index", "d_index")])
    return F.struct(
        user.alias("user_address"), F.lit(leg).alias("leg"),
        *[(F.coalesce(d, dlit(0)) if own[c] else dlit(0)).cast(D38).alias(c) for c in ("d_supply", "d_debt")],
        *[(F.col("idx") if own[c] else F.lit(None)).cast(D38).alias(c) for c in ("s_index", "d_index")],
        (is_up if isinstance(is_up, Column) else F.lit(is_up)).alias("is_up"),
        F.lit(clear).cast("string").alias("clear"),
        (toggle if toggle is not None else F.lit(None)).cast("boolean").alias("toggle"),
        (is_self if is_self is not None else F.lit(False)).alias("is_self"),
        (F.when(w.isNotNull(), wide) if side else F.lit(None)).cast(WIDE).alias("wide"),
        (F.col("__fault") if side else F.lit(None)).cast("string").alias("fault"))


def _exploded(events: DataFrame, asset: Column) -> DataFrame:
    """Events with ``token_type`` (null on collateral toggles) -> their legs."""
    e = _with_deltas(events)
    ev, tt = F.col("event"), F.col("token_type")
    frm, to = F.col("from_address"), F.col("to_address")
    is_a, is_d = tt == "atoken", tt == "vdebt"
    up = F.when(F.col("value").isNotNull() & F.col("balance_increase").isNotNull(), F.col("value") >= F.col("balance_increase"))
    if "exact" in events.columns:
        x = F.col("exact")
        up = F.coalesce(F.when(x.isNotNull(), x["value"] >= x["balance_increase"]), up)
    up = F.coalesce(up, F.lit(False))
    legs = (F.when(ev.isin(*COLLATERAL_EVENTS), F.array(_leg(F.col("user_address"), 0, toggle=ev == COLLATERAL_EVENTS[0])))
            .when(is_a & (ev == "Mint"), F.array(_leg(to, 0, "s", idx=True, is_up=up)))
            .when(is_a & (ev == "Burn"), F.array(_leg(frm, 0, "s", idx=True, clear="S")))
            .when(is_a & (ev == "BalanceTransfer"), F.array(
                _leg(frm, 0, "s", sign=-1, clear="S"), _leg(to, 1, "s", idx=True, is_up=True, is_self=(frm == to))))
            .when(is_d & (ev == "Mint"), F.array(_leg(to, 0, "d", idx=True, is_up=up)))
            .when(is_d & (ev == "Burn"), F.array(_leg(frm, 0, "d", idx=True, clear="D"))))
    out = e.select(asset.alias("asset_address"), "block_number", "log_index", "tx_hash", F.explode(legs).alias("__l"))
    return out.select(F.col("__l").getField("user_address").alias("user_address"), "asset_address", "block_number",
                      "log_index", "tx_hash", *[F.col("__l").getField(c).alias(c) for c in LEG_FIELDS if c != "user_address"])


def position_legs(token_events: DataFrame, collateral_events: DataFrame | None = None) -> DataFrame:
    """Explode resolved token events (and collateral toggles) into signed legs.

    ``token_events`` carry ``asset_address`` and ``token_type`` from
    :func:`tallyray.operators.joins.resolve_token`.  Output columns:
    user_address, asset_address, block_number, log_index, tx_hash, leg,
    d_supply, d_debt, s_index, d_index, is_up, clear, toggle, is_self, wide, fault.
    """
    out = _exploded(token_events.withColumn("user_address", F.lit(None).cast("string")), F.col("asset_address"))
    if collateral_events is not None:
        c = collateral_events.withColumn("token_type", F.lit(None).cast("string"))
        out = out.unionByName(_exploded(c, F.col("reserve")))
    return out


def legs_from_events(events: DataFrame, tmap: DataFrame) -> DataFrame:
    """Token and collateral events -> legs in ONE pass over the events.

    The emitter is resolved with a left broadcast join (the token map has one
    row per reserve token, its size is checked before broadcasting); token
    events of unknown emitters drop out, collateral toggles keep their
    reserve as the asset.  One explode builds every leg, so the de-duplicated
    events are consumed once.
    """
    from .joins import dim_join
    t = tmap.withColumnRenamed("token", "__token").withColumnRenamed("asset_address", "__asset")
    j = dim_join(events, t, F.col("address") == F.col("__token"), "left")
    is_coll = F.col("event").isin(*COLLATERAL_EVENTS)
    j = j.where(is_coll | (F.col("event").isin(*TOKEN_EVENTS) & F.col("token_type").isNotNull()))
    return _exploded(j, F.when(is_coll, F.col("reserve")).otherwise(F.col("__asset")))


def kept_legs(legs: DataFrame) -> DataFrame:
    """The legs with an amount; the others are :func:`ledger_rejects`."""
    return legs.where(F.col("fault").isNull()).drop("fault")


def ledger_rejects(legs: DataFrame) -> DataFrame:
    """Legs whose amount has no quotient, with the reason (``zero_index``, ``overflow``)."""
    return legs.where(F.col("fault").isNotNull()).select(
        *KEY, "block_number", "log_index", "tx_hash", "leg", F.col("fault").alias("reason"))


def _as_wide(lr: DataFrame) -> DataFrame:
    """Every leg's amounts as limbs."""
    own = {c: F.coalesce(F.col("wide")[c], u256.of_decimal(c)) for c in WIDE_FIELDS}
    return lr.select(*[own[c].alias(c) if c in own else F.col(c) for c in lr.columns])


def _stale_pred(stale_before) -> Column:
    if stale_before is None:
        return F.lit(False)
    sb, sl = stale_before
    return (F.col("block_number") < sb) | ((F.col("block_number") == sb) & (F.col("log_index") <= sl))


def block_bucket(bucket_blocks: int) -> Column:
    return F.floor(F.col("block_number") / bucket_blocks).cast("bigint")


def _prepared(legs: DataFrame, stale_before, bucket_blocks: int, seed: DataFrame | None) -> DataFrame:
    """Legs with their ordkey, bucket and whether they are at or before the seed's cut-off."""
    wide = F.col("wide") if "wide" in legs.columns else F.lit(None).cast(WIDE)
    base = legs.select(
        *KEY, "block_number", "log_index", "leg", "d_supply", "d_debt", "s_index", "d_index",
        "is_up", "clear", "toggle", "is_self", wide.alias("wide"),
        ordkey("block_number", "log_index", "leg").alias("ok"),
        block_bucket(bucket_blocks).alias("bkt"))
    # of the seed row's own cut-off the legs learn where they meet the seed
    pre = F.lit(None).cast("boolean") if stale_before == "row" else _stale_pred(stale_before)
    return base.withColumn("pre", pre)


def _before_cut() -> Column:
    """Whether a leg is at or before its seed row's own (block, log)."""
    return F.coalesce(ordkey("block_number", "log_index") <= F.col("cut"), F.lit(False))


def _cut_by_row(l0: DataFrame, seed_bal: DataFrame) -> DataFrame:
    """Legs with their seed row's cut-off joined on, then spread by (user, asset, bucket) so that a hot pair is not
    kept in one partition by the join's (user, asset) partitioning."""
    pairs = l0.select(*KEY).distinct()
    cut = seed_bal.join(pairs, KEY, "left_semi").select(*KEY, "cut")
    return l0.join(cut, KEY, "left").repartition(*KEY, "bkt").withColumn("pre", _before_cut()).drop("cut")


def _running(l0: DataFrame, cut: bool, num) -> DataFrame:
    """Running sums inside (user, asset, bucket), of all legs (ra_*) and of those after the cut-off (rp_*)."""
    l1 = l0.withColumn("ds0", F.when(F.col("is_self"), num.zero()).otherwise(F.col("d_supply"))).withColumn("dd0", F.col("d_debt"))
    w = (Window.partitionBy(*KEY, "bkt").orderBy("ok")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = l1.select("*", num.summed(F.col("ds0"), w).alias("ra_s"), num.summed(F.col("dd0"), w).alias("ra_d"))
    if not cut:
        # no cut-off: the post-snapshot sums equal the plain ones
        return out.withColumn("rp_s", F.col("ra_s")).withColumn("rp_d", F.col("ra_d"))
    post = lambda c: F.when(F.col("pre"), num.zero()).otherwise(F.col(c))
    return out.select("*", num.summed(post("ds0"), w).alias("rp_s"), num.summed(post("dd0"), w).alias("rp_d"))


def _legs_with_running(legs: DataFrame, stale_before, bucket_blocks: int, seed: DataFrame | None = None) -> DataFrame:
    """The windowed legs, amounts as single decimals."""
    return _running(_prepared(legs, stale_before, bucket_blocks, seed), stale_before is not None, Narrow)


def _bucket_info(lr: DataFrame, seed_bal: DataFrame | None, bucket_blocks: int, num) -> DataFrame:
    zero = num.zero()
    up_ok = F.when(F.col("is_up"), F.col("ok"))
    ba = lr.groupBy(*KEY, "bkt").agg(
        F.min(up_ok).alias("fu"),
        F.min_by(num.total((1, F.col("ra_s")), (-1, F.col("ds0"))), up_ok).alias("fu_before_s"),
        F.min_by(num.total((1, F.col("ra_d")), (-1, F.col("dd0"))), up_ok).alias("fu_before_d"),
        F.min_by(F.when(F.col("is_self"), F.col("d_supply")).otherwise(zero), up_ok).alias("fu_self_s"),
        num.summed(F.col("ds0")).alias("ta_s"), num.summed(F.col("dd0")).alias("ta_d"),
        num.summed(F.when(F.col("pre"), zero).otherwise(F.col("ds0"))).alias("tp_s"),
        num.summed(F.when(F.col("pre"), zero).otherwise(F.col("dd0"))).alias("tp_d"))
    if seed_bal is not None:
        ba = ba.join(seed_bal.drop("cut").hint("merge"), KEY, "left")
    else:
        ba = ba.select("*", F.lit(None).cast("boolean").alias("seeded"),
                       zero.alias("s0"), zero.alias("d0"))
    ba = ba.withColumn("seeded", F.coalesce(F.col("seeded"), F.lit(False)))
    pair = Window.partitionBy(*KEY)
    ba = ba.withColumn("creation", F.min("fu").over(pair))
    ba = ba.withColumn("cbkt", F.floor(ord_block("creation") / bucket_blocks).cast("bigint"))
    before = F.col("bkt") < F.col("cbkt")
    at = F.col("bkt") == F.col("cbkt")

    def kept(side):
        own = [(1, F.col(f"ta_{side}")), (-1, F.col(f"fu_before_{side}"))] + ([(1, F.col("fu_self_s"))] if side == "s" else [])
        return (F.when(F.col("seeded"), F.col(f"tp_{side}"))
                .when(F.col("creation").isNull() | before, zero)
                .when(at, num.total(*own))
                .otherwise(F.col(f"ta_{side}")))

    prev = pair.orderBy("bkt").rowsBetween(Window.unboundedPreceding, -1)
    ba = ba.withColumn("kept_s", kept("s")).withColumn("kept_d", kept("d"))
    ba = ba.withColumn("offset_s", num.summed(F.col("kept_s"), prev)).withColumn("offset_d", num.summed(F.col("kept_d"), prev))
    return ba.select(*KEY, "bkt", "seeded", "s0", "d0", "creation", "cbkt", "offset_s",
                     "offset_d", "fu_before_s", "fu_before_d", "fu_self_s")


def _effects(lr: DataFrame, bi: DataFrame, num) -> DataFrame:
    """The effects of legs by bucket (``lr``) from what lies before each bucket (``bi``)."""
    j = lr.join(bi, KEY + ["bkt"], "inner")
    at = F.col("bkt") == F.col("cbkt")

    def run(side):
        offset, all_ = (1, F.col(f"offset_{side}")), (1, F.col(f"ra_{side}"))
        own = [offset, all_, (-1, F.col(f"fu_before_{side}"))] + ([(1, F.col("fu_self_s"))] if side == "s" else [])
        return F.when(F.col("seeded"), num.total((1, F.col(f"{side}0")), offset, (1, F.col(f"rp_{side}")))) \
            .when(at, num.total(*own)).otherwise(num.total(offset, all_))

    return _flagged(j.withColumn("ph", pair_hash()), run("s"), run("d"), num)


def _pair_effects(l0: DataFrame, seed_bal: DataFrame | None, bucket_blocks: int, tasks: int, num) -> DataFrame:
    """The effects of legs by pair, in one window over its legs in chain order, in ``tasks`` tasks.

    A creation is the first up leg in that order, so the least up leg so far is the creation from there on.  The
    hash of the pair leads the window's keys, so that most comparisons of its sort end at one number; it and what
    follows from a leg's place are computed behind the shuffle.

    A pair's seed row goes to the same shuffle and lies before its legs in the window.  Joined onto the legs, the seed
    would be broadcast whenever the planner takes it for small, and else sort the legs once more.
    """
    zero = num.zero()
    by_row = seed_bal is not None and "cut" in seed_bal.columns
    more = ["cut"] if by_row else []
    # A leg without a user or an asset is nobody's.  One without a block is no leg of the result, but its amount counts
    # in the balances from the creation on.
    owned = F.col("user_address").isNotNull() & F.col("asset_address").isNotNull()
    l1 = l0.where(owned).drop("ok", "bkt")
    if seed_bal is not None:
        still = {"d_supply": zero, "d_debt": zero, "is_up": F.lit(False), "is_self": F.lit(False)}
        rows = seed_bal.where(owned).select(*[
            c if c in KEY else still.get(c, F.lit(None)).cast(l1.schema[c].dataType).alias(c) for c in l1.columns], "seeded", "s0", "d0", *more)
        l1 = l1.unionByName(rows, allowMissingColumns=True)
    l1 = l1.repartition(tasks, *KEY).withColumn("ph", pair_hash()) \
           .withColumn("ok", ordkey("block_number", "log_index", "leg")).withColumn("bkt", block_bucket(bucket_blocks))
    first = [] if seed_bal is None else [F.col("seeded").asc_nulls_last()]
    w = (Window.partitionBy("ph", *KEY).orderBy(*first, "bkt", F.col("ok").isNotNull(), "block_number", "log_index", "leg")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if seed_bal is None:
        l1 = l1.select("*", F.lit(False).alias("seeded"), zero.alias("s0"), zero.alias("d0"))
        own = {}
    else:
        own = {"seeded": F.coalesce(F.first("seeded").over(w), F.lit(False)), **{c: F.first(c).over(w) for c in ("s0", "d0", *more)}}
    l2 = l1.withColumns({"creation": F.min(F.when(F.col("is_up"), F.col("ok"))).over(w), **own})
    if by_row:
        l2 = l2.withColumn("pre", _before_cut()).drop("cut")
    creation, self_ = F.col("creation"), F.col("is_self")

    def run(side):
        d = F.col("d_supply" if side == "s" else "d_debt")
        lost = self_ if side == "s" else F.lit(False)
        seeded = F.when(F.col("pre") | lost, zero).otherwise(d)
        early = creation.isNull() & F.col("bkt").isNotNull()
        unseeded = F.when(early | (lost & ~F.coalesce(creation == F.col("ok"), F.lit(False))), zero).otherwise(d)
        return num.summed(F.when(F.col("seeded"), seeded).otherwise(unseeded), w)

    # the seed rows go here, too: they have no block
    l3 = l2.select("*", run("s").alias("__s"), run("d").alias("__d")).where(F.col("bkt").isNotNull())
    plus = lambda side: F.when(F.col("seeded"), num.total((1, F.col(f"{side}0")), (1, F.col(f"__{side}")))).otherwise(F.col(f"__{side}"))
    return _flagged(l3, plus("s"), plus("d"), num)


def pair_hash() -> Column:
    return F.xxhash64(*KEY)


def _flagged(j: DataFrame, run_s: Column, run_d: Column, num) -> DataFrame:
    """Legs with their creation, whether their pair is seeded, and their running balances -> their fate and flag events."""
    zero = num.zero()
    seeded, ok, creation = F.col("seeded"), F.col("ok"), F.col("creation")
    kept = F.when(seeded, ~F.col("pre") & ~F.col("is_self")).otherwise(
        creation.isNotNull() & (ok >= creation) & (~F.col("is_self") | (ok == creation)))
    is_creation = ~seeded & (ok == F.coalesce(creation, F.lit(None)))
    j = j.withColumn("kept", F.coalesce(kept, F.lit(False))) \
         .withColumn("is_creation", F.coalesce(is_creation, F.lit(False))) \
         .withColumn("run_s", run_s).withColumn("run_d", run_d)
    k = F.col("kept")
    clear = F.col("clear")
    empty_s, empty_d = num.nonpositive(F.col("run_s")), num.nonpositive(F.col("run_d"))
    coll_ev = (F.when(~k, F.lit(None).cast("boolean"))
               .when(F.col("toggle").isNotNull(), F.col("toggle"))
               .when(F.col("is_creation"), F.lit(False))
               .when((clear == "S") & empty_s, F.lit(False)))
    act_ev = (F.when(~k, F.lit(None).cast("boolean"))
              .when(F.col("is_up"), F.lit(True))
              .when(clear.isNotNull() & empty_s & empty_d, F.lit(False)))
    sidx = F.when(k, F.when(F.col("is_creation"), F.coalesce("s_index", zero)).otherwise(F.col("s_index")))
    didx = F.when(k, F.when(F.col("is_creation"), F.coalesce("d_index", zero)).otherwise(F.col("d_index")))
    stale = seeded & F.col("pre")
    return j.select(
        "ph", *KEY, "block_number", "log_index", "leg", "ok", "bkt", "d_supply", "d_debt",
        "kept", "is_creation", "seeded", "creation", "run_s", "run_d",
        coll_ev.alias("coll_ev"), act_ev.alias("act_ev"), sidx.alias("sidx_ev"), didx.alias("didx_ev"),
        (stale & (clear == "S")).alias("stale_clear_s"),
        (stale & clear.isNotNull()).alias("stale_clear"))


def _both_effects(legs: DataFrame, seed, stale_before, bucket_blocks: int, materialize: bool) -> list[tuple[type, DataFrame]]:
    """The effects of the legs of narrow pairs and, when legs can be wide, those of pairs with a wide leg."""
    l0 = _prepared(legs, stale_before, bucket_blocks, seed)
    if materialize:
        # The legs are stored once, as parquet: they are read for the hot pairs
        # and wide legs (few columns), and then by the folds.
        l0 = stored(l0, "legs")
    # Hot pairs and wide legs are rare: their parts of the plan are built only when there are some.  A pair is known
    # by its hash: one that shares the hash of a hot one goes by the bucket too, which gives the same rows.
    by_hash = lambda df: df.groupBy(pair_hash().alias("ph")).agg(F.count(F.lit(1)).alias("n"))
    counted = l0.select(pair_hash().alias("ph"), F.lit(1).alias("leg"), F.lit(0).alias("row"), F.col("wide").isNotNull().alias("wide"))
    if seed is not None:
        counted = counted.unionByName(seed.select(pair_hash().alias("ph"), F.lit(0).alias("leg"), F.lit(1).alias("row"), wide_seed().alias("wide")))
    pairs = counted.groupBy("ph").agg(F.sum("leg").alias("legs"), F.sum("row").alias("rows"), F.max("wide").alias("wide"))
    most = pairs.agg(F.max("legs").alias("legs"), F.max("rows").alias("rows"), F.max("wide").alias("wide"),
                     F.sum(F.col("legs") + F.col("rows")).alias("n")).first()
    tasks = tasks_for(most.n or 0)
    hot = [by_hash(l0).where(F.col("n") > HOT_LEGS).select("ph")] if (most.legs or 0) > HOT_LEGS else []
    if (most.rows or 0) > 1:
        hot.append(by_hash(seed).where("n > 1").select("ph"))
    hot = stored(hot[0].union(hot[-1]), "pairs") if hot else None
    if not most.wide:
        return [(Narrow, _split_effects(l0, seed, stale_before, bucket_blocks, hot, tasks, Narrow))]
    some = l0.where(F.col("wide").isNotNull()).select(*KEY)
    if seed is not None:
        some = some.union(seed.where(wide_seed()).select(*KEY))
    some = some.distinct()
    return [(num, _split_effects(part, seed, stale_before, bucket_blocks, hot, tasks, num)) for num, part in (
        (Narrow, l0.join(some, KEY, "left_anti")), (Wide, _as_wide(l0.join(some, KEY, "left_semi"))))]


def _split_effects(l0: DataFrame, seed, stale_before, bucket_blocks: int, hot: DataFrame | None,
                   tasks: int, num) -> DataFrame:
    """The effects of legs, those of pairs with a hash in ``hot`` by the block bucket."""
    seed_bal = None if seed is None else seed.select(
        *KEY, F.lit(True).alias("seeded"), num.of_seed(F.col("scaled_atoken_balance")).alias("s0"),
        num.of_seed(F.col("scaled_variable_debt")).alias("d0"),
        *([ordkey("last_updated_block", "last_updated_log_index").alias("cut")] if stale_before == "row" else []))
    if hot is None:
        return _pair_effects(l0, seed_bal, bucket_blocks, tasks, num)
    ph = l0.withColumn("ph", pair_hash())
    hot_legs = ph.join(hot, "ph", "left_semi").drop("ph")
    if stale_before == "row":
        hot_legs = _cut_by_row(hot_legs, seed_bal)
    lr = _running(hot_legs, stale_before is not None, num)
    by_bucket = _effects(lr, _bucket_info(lr, seed_bal, bucket_blocks, num), num)
    if seed_bal is not None:
        seed_bal = seed_bal.withColumn("ph", pair_hash()).join(hot, "ph", "left_anti").drop("ph")
    return _pair_effects(ph.join(hot, "ph", "left_anti").drop("ph"), seed_bal, bucket_blocks, tasks, num).unionByName(by_bucket)


def _shown(df: DataFrame, num, amounts: list[str]) -> DataFrame:
    """Amounts as decimal(38,0) (null beyond) plus their exact texts in ``exact`` (null when all are narrow)."""
    if num is Narrow:
        return df.withColumn("exact", F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in amounts) + ">"))
    texts = F.struct(*[u256.text(c).alias(c) for c in amounts])
    return df.select(*[u256.decimal(c).alias(c) if c in amounts else F.col(c) for c in df.columns], texts.alias("exact"))


def leg_effects(legs: DataFrame, seed: DataFrame | None = None, stale_before=None,
                bucket_blocks: int = DEFAULT_BUCKET_BLOCKS, materialize: bool = True) -> DataFrame:
    """Every leg with its fate (kept / stale), running balances after it, and
    the flag events it produces.  This is the ``running_balance`` history.

    With wide legs, ``exact`` holds the exact texts of pairs that have one.
    """
    parts = _both_effects(legs, seed, stale_before, bucket_blocks, materialize)
    parts = [(num, df.drop("ph")) for num, df in parts]
    if len(parts) == 1:
        return parts[0][1]
    shown = [_shown(df, num, ["d_supply", "d_debt", "run_s", "run_d", "sidx_ev", "didx_ev"]) for num, df in parts]
    return shown[0].unionByName(shown[1])


def fold_positions(legs: DataFrame, seed: DataFrame | None = None, stale_before=None,
                   bucket_blocks: int = DEFAULT_BUCKET_BLOCKS, materialize: bool = True) -> DataFrame:
    """Fold legs (optionally on top of seed ``user_positions`` rows) into the
    ``user_positions`` table.

    ``stale_before=(block, log)`` is the ordkey of the seed snapshot: legs at
    or before it are stale for seeded pairs (only their unguarded clear step
    acts, on the seed balances).  ``stale_before="row"`` takes each seed row's
    own ``last_updated`` as its cut-off (exact for seeds from earlier folds; it
    travels with the seed row).  Without it every
    leg is newer than the seed.
    """
    parts = _both_effects(legs, seed, stale_before, bucket_blocks, materialize)
    if seed is not None and len(parts) == 2:
        # an untouched seed row goes by its own size
        wide_pairs = parts[1][1].select(*KEY).distinct().withColumn("__wide", F.lit(True))
        marked = seed.join(wide_pairs, KEY, "left").withColumn("__wide", F.coalesce("__wide", F.lit(False)) | wide_seed())
        seeds = [marked.where("not __wide").drop("__wide"), marked.where("__wide").drop("__wide")]
    else:
        seeds = [seed, seed]
    folds = [_folded(fx, own, num) for (num, fx), own in zip(parts, seeds)]
    if len(folds) == 1:
        return folds[0]
    shown = [_shown(df, num, list(AMOUNTS)) for (num, _), df in zip(parts, folds)]
    return shown[0].unionByName(shown[1])


AMOUNTS = ("scaled_atoken_balance", "scaled_variable_debt", "atoken_last_index", "debt_last_index")


def wide_seed() -> Column:
    """Whether a seed row (decimals, or decimal texts) holds an amount of more than 36 digits."""
    return F.greatest(*[F.coalesce(F.length(F.regexp_replace(F.col(c).cast("string"), "^-?0*", "")) > 36, F.lit(False)) for c in AMOUNTS])


def exact_texts(positions: DataFrame) -> DataFrame:
    """Folded positions with every amount as its exact decimal text."""
    if "exact" not in positions.columns:
        return positions.select(*[F.col(c).cast("string").alias(c) if c in AMOUNTS else F.col(c) for c in positions.columns])
    return positions.select(*[F.coalesce(F.col("exact")[c], F.col(c).cast("string")).alias(c) if c in AMOUNTS else F.col(c)
                              for c in positions.columns if c != "exact"])


def _leg_totals(num) -> list[Column]:
    """What a group of leg effects amounts to: sums, the latest flags and indexes, the last kept leg, the creation."""
    zero = num.zero()
    kept = lambda c: F.when(F.col("kept"), F.col(c)).otherwise(zero)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ok")))
    return [num.summed(kept("d_supply")).alias("sum_s"), num.summed(kept("d_debt")).alias("sum_d"),
            latest("coll_ev").alias("coll"), latest("act_ev").alias("act"),
            latest("sidx_ev").alias("sidx"), latest("didx_ev").alias("didx"),
            F.max(F.when(F.col("kept"), F.col("ok"))).alias("last_ok"), F.min("creation").alias("creation")]


def _unseeded_columns() -> list[Column]:
    """The position columns of a pair that began with its creation leg, from its totals."""
    return [F.col("sum_s").alias("scaled_atoken_balance"), F.col("sum_d").alias("scaled_variable_debt"),
            F.coalesce("coll", F.lit(False)).alias("use_as_collateral"),
            F.col("sidx").alias("atoken_last_index"), F.col("didx").alias("debt_last_index"),
            ord_block("last_ok").alias("last_updated_block"), ord_log("last_ok").alias("last_updated_log_index"),
            F.coalesce("act", F.lit(True)).alias("is_active"), ord_block("creation").alias("created_at_block")]


def _folded(fx: DataFrame, seed: DataFrame | None, num) -> DataFrame:
    zero = num.zero()
    pair = fx.groupBy(*KEY).agg(*_leg_totals(num), F.max("stale_clear_s").alias("any_scs"), F.max("stale_clear").alias("any_sc"))
    if seed is None:
        return pair.where(F.col("creation").isNotNull()).select(*KEY, *_unseeded_columns())
    s = seed.select(*KEY, F.lit(True).alias("__seeded"),
                    *[(num.of_seed(F.col(c)) if c in AMOUNTS else F.col(c)).alias(f"__{c}") for c in seed.columns if c not in KEY])
    m = pair.join(s, KEY, "full_outer")
    seeded = F.coalesce(F.col("__seeded"), F.lit(False))
    touched = F.col("last_ok").isNotNull()
    s0, d0 = F.col("__scaled_atoken_balance"), F.col("__scaled_variable_debt")
    empty_s, empty_d = num.nonpositive(s0), num.nonpositive(d0)
    plus = lambda x, own: F.when(seeded, num.total((1, x), (1, F.coalesce(F.col(own), zero)))).otherwise(F.col(own))
    return m.where(seeded | F.col("creation").isNotNull()).select(
        *KEY,
        plus(s0, "sum_s").alias("scaled_atoken_balance"),
        plus(d0, "sum_d").alias("scaled_variable_debt"),
        F.coalesce(F.col("coll"),
                   F.when(F.coalesce("any_scs", F.lit(False)) & empty_s, F.lit(False)),
                   F.col("__use_as_collateral"), F.lit(False)).alias("use_as_collateral"),
        F.coalesce("sidx", "__atoken_last_index").alias("atoken_last_index"),
        F.coalesce("didx", "__debt_last_index").alias("debt_last_index"),
        F.when(touched, ord_block("last_ok")).otherwise(F.col("__last_updated_block"))
        .alias("last_updated_block"),
        F.when(touched, ord_log("last_ok")).otherwise(F.col("__last_updated_log_index"))
        .alias("last_updated_log_index"),
        F.coalesce(F.col("act"),
                   F.when(F.coalesce("any_sc", F.lit(False)) & empty_s & empty_d, F.lit(False)),
                   F.col("__is_active"), F.lit(True)).alias("is_active"),
        F.when(seeded, F.col("__created_at_block")).otherwise(ord_block("creation"))
        .alias("created_at_block"))


def anchor_spans(anchors: DataFrame) -> DataFrame:
    """anchor, n (its place, from 0), prev (the anchor before, -1 for the first) and anchors (their number), one row per
    distinct ``anchor`` that is not null.  One row per anchor, whatever the ledger's size."""
    order, whole = Window.orderBy("anchor"), Window.partitionBy()
    return (anchors.select(F.col("anchor").cast("bigint").alias("anchor")).where("anchor >= 0").distinct()
            .select("anchor", (F.row_number().over(order) - 1).alias("n"),
                    F.coalesce(F.lag("anchor").over(order), F.lit(-1)).alias("prev"), F.count("*").over(whole).alias("anchors")))


def states_at(legs: DataFrame, anchors: DataFrame, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS, materialize: bool = True) -> DataFrame:
    """The positions as of every block in ``anchors`` (column ``anchor``), from one pass over the legs.

    A leg's effect hangs on earlier legs only, so the effects are computed once.
    They are summed per (user, asset, span between two anchors) with partial
    aggregation, carried over a pair's touched spans by a window of one row per
    span, and every such row stands for the anchors up to the pair's next
    touched span.  A pair has a row at an anchor once it was created at or
    before it.  Null, negative and repeated anchors give nothing of their own.
    A leg meets its span by its block bucket, so anchors cost one small row per
    bucket they span, also beyond the last leg.
    """
    from .joins import dim_join
    spans = anchor_spans(anchors)
    bucket = lambda b: F.floor(b / bucket_blocks).cast("bigint")
    by_bucket = spans.select("n", "prev", "anchor", "anchors", F.explode(
        F.sequence(bucket(F.col("prev") + 1), bucket(F.col("anchor")))).alias("span_bkt"))
    inside = (F.col("bkt") == F.col("span_bkt")) & (F.col("block_number") > F.col("prev")) & (F.col("block_number") <= F.col("anchor"))
    touched = Window.partitionBy(*KEY).orderBy("n")
    upto = touched.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def states(fx: DataFrame, num) -> DataFrame:
        part = (dim_join(fx, by_bucket, inside).groupBy(*KEY, "n", "anchors").agg(*_leg_totals(num))
                .where(F.col("last_ok").isNotNull()))
        carried = part.select(
            *KEY, *[num.summed(F.col(c), upto).alias(c) for c in ("sum_s", "sum_d")],
            *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("coll", "act", "sidx", "didx")],
            "last_ok", "creation", "n", F.coalesce(F.lead("n").over(touched), F.col("anchors").cast("int")).alias("until"))
        carried = carried.withColumn("n", F.explode(F.sequence(F.col("n"), F.col("until") - 1)))
        return dim_join(carried, spans.select("n", "anchor"), "n").select("anchor", *KEY, *_unseeded_columns())

    parts = _both_effects(legs, None, None, bucket_blocks, materialize)
    folds = [states(fx, num) for num, fx in parts]
    if len(folds) == 1:
        return folds[0]
    shown = [_shown(df, num, list(AMOUNTS)) for (num, _), df in zip(parts, folds)]
    return shown[0].unionByName(shown[1])


def balances(legs: DataFrame, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS) -> DataFrame:
    """Only the scaled balances per (user, asset): the minimum slice."""
    out = exact_texts(fold_positions(legs, bucket_blocks=bucket_blocks))
    return out.select(*KEY, "scaled_atoken_balance", "scaled_variable_debt")


def touched_pairs(token_events: DataFrame) -> DataFrame:
    """Distinct (user, asset) touched by Mint.onBehalfOf, Burn.from and both
    sides of BalanceTransfer; the zero address is removed."""
    ev = F.col("event")
    users = (F.when(ev == "Mint", F.array("to_address"))
             .when(ev == "Burn", F.array("from_address"))
             .when(ev == "BalanceTransfer", F.array("from_address", "to_address")))
    x = token_events.select(F.explode(users).alias("user_address"), "asset_address")
    return x.where(F.col("user_address") != F.lit("0x" + "0" * 40)).distinct()
