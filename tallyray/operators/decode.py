"""Raw logs -> typed events, as column expressions (one narrow projection).

Routing uses literal maps keyed by topic0 (29 entries, no join).  Each event
has a field spec: where every argument lives (topic i or data word j) and its
ABI type.  A log decodes when the topic count matches, enough data words are
present and every field converts; otherwise it goes to the rejects output with
a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uint256
from ..functions.topics import EVENTS, FAMILY, TOPIC
from ..functions.words import (D38, hex_body, is_word, string_from_words, topic_word,
                               word_to_address, word_to_bool, word_to_long, word_to_uint)

# (output column, location, ABI type); location "tN" = topic N, "wN" = data word N
ASSET = ("asset", "t1", "address")
SPECS: dict[str, list[tuple[str, str, str]]] = {
    "ReserveInitialized": [ASSET, ("atoken_address", "t2", "address"),
                           ("s_debt_token_address", "w0", "address"),
                           ("v_debt_token_address", "w1", "address"),
                           ("strategy", "w2", "address")],
    "ReserveUsedAsCollateralEnabled": [("reserve", "t1", "address"), ("user_address", "t2", "address")],
    "ReserveUsedAsCollateralDisabled": [("reserve", "t1", "address"), ("user_address", "t2", "address")],
    "ReserveDataUpdated": [ASSET, ("liquidity_rate", "w0", "uint"), ("stable_borrow_rate", "w1", "uint"),
                           ("variable_borrow_rate", "w2", "uint"), ("liquidity_index", "w3", "uint"),
                           ("variable_borrow_index", "w4", "uint")],
    "UserEModeSet": [("user_address", "t1", "address"), ("category_id", "w0", "uint8")],
    "ReserveStableRateBorrowing": [ASSET, ("flag", "w0", "bool")],
    "ReserveDropped": [ASSET],
    "ReserveFactorChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "ReserveInterestRateStrategyChanged": [ASSET, ("old_strategy", "w0", "address"),
                                           ("strategy", "w1", "address")],
    "CollateralConfigurationChanged": [ASSET, ("ltv", "w0", "long"),
                                       ("liquidation_threshold", "w1", "long"),
                                       ("liquidation_bonus", "w2", "long")],
    "ReserveFrozen": [ASSET],
    "ReserveUnfrozen": [ASSET],
    "ReservePaused": [ASSET, ("flag", "w0", "bool")],
    "ReserveBorrowing": [ASSET, ("flag", "w0", "bool")],
    "ReserveActive": [ASSET, ("flag", "w0", "bool")],
    "BorrowCapChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "SupplyCapChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "LiquidationProtocolFeeChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "DebtCeilingChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "ReserveFlashLoaning": [ASSET, ("flag", "w0", "bool")],
    "AssetCollateralInEModeChanged": [ASSET, ("category_id", "w0", "uint8"), ("flag", "w1", "bool")],
    "AssetBorrowableInEModeChanged": [ASSET, ("category_id", "w0", "uint8"), ("flag", "w1", "bool")],
    "AssetLtvzeroInEModeChanged": [ASSET, ("category_id", "w0", "uint8"), ("flag", "w1", "bool")],
    "EModeCategoryAdded": [("category_id", "t1", "uint8"), ("ltv", "w0", "long"),
                           ("liquidation_threshold", "w1", "long"),
                           ("liquidation_bonus", "w2", "long"), ("oracle", "w3", "address"),
                           ("label", "w4", "string")],
    "SiloedBorrowingChanged": [ASSET, ("old_flag", "w0", "bool"), ("flag", "w1", "bool")],
    "UnbackedMintCapChanged": [ASSET, ("old_amount", "w0", "uint"), ("new_amount", "w1", "uint")],
    "Mint": [("from_address", "t1", "address"), ("to_address", "t2", "address"),
             ("value", "w0", "uint"), ("balance_increase", "w1", "uint"), ("idx", "w2", "uint")],
    "Burn": [("from_address", "t1", "address"), ("to_address", "t2", "address"),
             ("value", "w0", "uint"), ("balance_increase", "w1", "uint"), ("idx", "w2", "uint")],
    "BalanceTransfer": [("from_address", "t1", "address"), ("to_address", "t2", "address"),
                        ("value", "w0", "uint"), ("idx", "w1", "uint")],
}

OUT_TYPES = {"address": "string", "uint": D38, "long": "bigint", "bool": "boolean",
             "uint8": "int", "string": "string"}


def _out_columns() -> dict[str, object]:
    cols: dict[str, object] = {}
    for spec in SPECS.values():
        for name, _, typ in spec:
            cols.setdefault(name, OUT_TYPES[typ])
    return cols


OUT_COLUMNS = _out_columns()


def _lit_map(d: dict[str, str]) -> Column:
    args = []
    for k, v in d.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def _convert(w: Column, loc: str, typ: str) -> Column:
    """One ABI argument from its 32-byte word (hex text)."""
    if typ == "address":
        return word_to_address(w)
    if typ == "uint":
        return word_to_uint(w)
    if typ == "long":
        return word_to_long(w)
    if typ == "bool":
        return word_to_bool(w)
    if typ == "uint8":
        v = word_to_long(w)
        return F.when(v < 256, v.cast("int"))
    if typ == "string":
        return string_from_words(F.col("data"), int(loc[1:]))
    raise ValueError(typ)


def route_events(logs: DataFrame) -> DataFrame:
    """Add ``event`` and ``family`` from topic0; logs without topics drop out,
    unknown topics route to the default (reserve) family with a null event."""
    t0 = F.lower(F.get(F.col("topics"), 0))
    name_by_topic = {TOPIC[n]: n for n, _, _ in EVENTS}
    fam_by_topic = {TOPIC[n]: FAMILY[n] for n, _, _ in EVENTS}
    return logs.where(F.size("topics") > 0).select(
        "*", _lit_map(name_by_topic)[t0].alias("event"),
        F.coalesce(_lit_map(fam_by_topic)[t0], F.lit("reserve")).alias("family"))


def _needed(names: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for name in names:
        for _, loc, typ in SPECS[name]:
            if (loc, typ) not in out:
                out.append((loc, typ))
    return out


def _vcol(loc: str, typ: str) -> str:
    return f"__v_{loc}_{typ}"


def _with_values(routed: DataFrame, names: list[str]) -> DataFrame:
    """Materialise every needed word once, then every (location, type)
    conversion once, so each output column only picks among ready values."""
    needed = _needed(names)
    locs = sorted({loc for loc, _ in needed})
    # the data body (prefix stripped, lower case) once per row, then substrings
    body = routed.select("*", hex_body(F.col("data")).alias("__body"))
    word = lambda loc: (topic_word(F.col("topics"), int(loc[1:])) if loc[0] == "t"
                        else F.substring(F.col("__body"), 64 * int(loc[1:]) + 1, 64))
    words = body.select("*", *[word(loc).alias(f"__w_{loc}") for loc in locs],
                        F.size("topics").alias("__nt"),
                        F.floor(F.length("__body") / 64).cast("int").alias("__nw"))
    vals = [_convert(F.col(f"__w_{loc}"), loc, typ).alias("__c" + _vcol(loc, typ)[3:])
            for loc, typ in needed]
    # The conversions are computed in a projection (code generation splits it
    # into methods) and then passed through a one-row generator: predicates on
    # them (validity, consumers' filters) read the generated columns instead of
    # being pushed below and recomputing every conversion a second time.
    conv = words.select("*", *vals)
    names_c = ["__c" + _vcol(loc, typ)[3:] for loc, typ in needed]
    gen = F.inline(F.array(F.struct(*[F.col(c).alias(_vcol(loc, typ))
                                      for c, (loc, typ) in zip(names_c, needed)])))
    return conv.select(*[c for c in conv.columns if c not in names_c], gen)


def _decode_columns(names: list[str]) -> tuple[list[Column], Column]:
    """Typed columns for the given events plus a validity predicate, over the
    columns prepared by :func:`_with_values`."""
    ev = F.col("event")
    cols = []
    for out, typ in OUT_COLUMNS.items():
        # events grouped by where this field lives: usually one source for all
        by_source: dict[tuple[str, str], list[str]] = {}
        for name in names:
            for fname, loc, ftyp in SPECS[name]:
                if fname == out:
                    by_source.setdefault((loc, ftyp), []).append(name)
        expr = None
        for (loc, ftyp), evs in by_source.items():
            v = F.col(_vcol(loc, ftyp)).cast(typ)
            cond = ev.isin(*evs)
            expr = F.when(cond, v) if expr is None else expr.when(cond, v)
        if expr is not None:
            cols.append(expr.alias(out))
    # validity through literal lookups keyed by event name: the predicate grows
    # with the number of (location, type) kinds, not with events x fields
    nt_map = {n: str(1 + sum(1 for _, loc, _ in SPECS[n] if loc[0] == "t")) for n in names}
    nw_map = {n: str(sum(1 for _, loc, _ in SPECS[n] if loc[0] == "w")) for n in names}
    str_map = {n: str(any(t == "string" for _, _, t in SPECS[n])).lower() for n in names}
    want_nt = _lit_map(nt_map)[ev].cast("int")
    want_nw = _lit_map(nw_map)[ev].cast("int")
    has_str = _lit_map(str_map)[ev] == "true"
    ok = (F.col("__nt") == want_nt) & F.when(has_str, F.col("__nw") >= want_nw) \
        .otherwise(F.col("__nw") == want_nw)
    for loc, typ in _needed(names):
        users = [n for n in names if any(l2 == loc and t2 == typ for _, l2, t2 in SPECS[n])]
        need = ev.isin(*users)
        found = F.col(_vcol(loc, typ)).isNotNull()
        if typ == "uint":  # amounts of token events may be wide: see _exact_amounts
            found = found | (ev.isin(*AMOUNT_EVENTS) & is_word(F.col(f"__w_{loc}")))
        ok = ok & (~need | found)
    ok = ev.isin(*names) & F.coalesce(ok, F.lit(False))
    return cols, ok


AMOUNT_EVENTS = ("Mint", "Burn", "BalanceTransfer")


def _exact_amounts() -> Column:
    """The amounts of a token event as limbs when one of its words is beyond the 38-digit path, else null."""
    ev = F.col("event")
    w0, w1, w2 = (F.col(f"__w_w{k}") for k in range(3))
    transfer = ev == "BalanceTransfer"
    value, v1, v2 = (F.col(_vcol(f"w{k}", "uint")) for k in range(3))
    wide = value.isNull() | v1.isNull() | (~transfer & v2.isNull())
    none = F.lit(None).cast(uint256.LIMBS)
    exact = F.struct(uint256.of_word(w0).alias("value"),
                     F.when(transfer, none).otherwise(uint256.of_word(w1)).alias("balance_increase"),
                     uint256.of_word(F.when(transfer, w1).otherwise(w2)).alias("idx"))
    return F.when(ev.isin(*AMOUNT_EVENTS) & wide, exact)


def decode_logs(logs: DataFrame, events: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode the given event types; rows that fail are dropped here and
    reported by :func:`decode_rejects`.

    Token events also carry ``exact``: their amounts as limbs where one does
    not fit the 38-digit columns (which are null there), else null.
    """
    routed = route_events(logs).where(F.col("event").isin(*events))
    prepared = _with_values(routed, events)
    cols, ok = _decode_columns(events)
    # position fields: required for token / collateral / user-eMode logs; a
    # reserve log defaults a missing block or log index to 0; a missing tx
    # hash is never accepted
    ev = F.col("event")
    strict = ev.isin(*TOKEN_FAMILY, *USER_EMODE_FAMILY)
    has_pos = F.col("tx_hash").isNotNull() & (
        ~strict | (F.col("block_number").isNotNull() & F.col("log_index").isNotNull()))
    base = ["address", F.coalesce("block_number", F.lit(0).cast("bigint")).alias("block_number"),
            F.coalesce("log_index", F.lit(0).cast("bigint")).alias("log_index"), "tx_hash", "event"]
    if all(e in events for e in AMOUNT_EVENTS):
        cols = [*cols, _exact_amounts().alias("exact")]
    return prepared.where(ok & has_pos).select(*base, *cols, *keep)


TOKEN_FAMILY = ["Mint", "Burn", "BalanceTransfer",
                "ReserveUsedAsCollateralEnabled", "ReserveUsedAsCollateralDisabled"]
USER_EMODE_FAMILY = ["UserEModeSet"]
RESERVE_FAMILY = [n for n, _, f in EVENTS if f == "reserve"]


# The text of a word that converts, by ABI type (uint: the 38-digit path; a string's word is an offset).
WORD_OF = {"address": "[0-9a-f]{64}", "uint": "0{32}[0-3][0-9a-f]{31}", "long": "0{48}[0-7][0-9a-f]{15}",
           "bool": "0{63}[01]", "uint8": "0{62}[0-9a-f]{2}", "string": r"[\s\S]{64}"}
LINE_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?"  # may follow a topic's word, as ``$`` lets it
WIDE_WORD = r"^(?:[\s\S]{64}){0,4}(?!0{32}[0-3])[0-9a-f]{64}"  # among the first five


def _shape(name: str) -> str:
    """The pattern of a log's shape text (topic count, topics, body) when all fields of the event convert."""
    spec = SPECS[name]
    form = lambda typ: "[0-9a-f]{64}" if typ == "uint" and name in AMOUNT_EVENTS else WORD_OF[typ]
    at = {loc: form(typ) for _, loc, typ in spec}
    topics = ",".join(at[f"t{i}"] + LINE_END if f"t{i}" in at else "" for i in range(1, 4))
    words = "".join(at[loc] for loc in sorted(at) if loc[0] == "w")
    rest = "*" if any(typ == "string" for _, _, typ in spec) else "{0,63}"
    return rf"\A{1 + sum(loc[0] == 't' for loc in at)}:{topics}:{words}[\s\S]{rest}\z"


def decode_rejects(logs: DataFrame) -> DataFrame:
    """Every log that does not become a typed event, with the reason.

    Whether all fields convert is read off the text of topics and data with one
    pattern, that of the log's own event; no value is built.
    """
    has_topics = F.size("topics") > 0
    t0 = F.lower(F.get(F.col("topics"), 0))
    known = _lit_map({TOPIC[n]: n for n, _, _ in EVENTS})[t0]
    topic = lambda i: F.coalesce(topic_word(F.col("topics"), i), F.lit(""))
    # one-row generators: what is read more than once is worked out once
    lg = logs.select("*", F.when(has_topics, known).alias("event"),
                     F.explode(F.array(hex_body(F.col("data")))).alias("__body"))
    lg = lg.select("*", F.explode(F.array(F.concat(
        F.size("topics").cast("string"), F.lit(":"), topic(1), F.lit(","), topic(2), F.lit(","), topic(3),
        F.lit(":"), F.col("__body")))).alias("__shape"))
    ev = F.col("event")
    shapes: dict[str, list[str]] = {}
    for name, _, _ in EVENTS:
        shapes.setdefault(_shape(name), []).append(name)
    ok = None
    for pattern, names in shapes.items():
        fits = F.col("__shape").rlike(pattern)
        for _, loc, typ in SPECS[names[0]]:
            if typ == "string":
                fits = fits & string_from_words(F.col("data"), int(loc[1:])).isNotNull()
        ok = F.when(ev.isin(*names), fits) if ok is None else ok.when(ev.isin(*names), fits)
    lg = lg.select("*", F.explode(F.array(F.coalesce(ok, F.lit(False)))).alias("__ok"))
    position_needed = ev.isin(*TOKEN_FAMILY, *USER_EMODE_FAMILY)
    missing_pos = F.col("tx_hash").isNull() | (position_needed & (
        F.col("block_number").isNull() | F.col("log_index").isNull()))
    reason = (F.when(~has_topics, "no_topics")
              .when(ev.isNull(), "unknown_topic")
              .when(missing_pos, "missing_position")
              .when(~F.col("__ok") & F.col("__body").rlike(WIDE_WORD), "wide_value")
              .when(~F.col("__ok"), "malformed"))
    return lg.select("address", "block_number", "log_index", "tx_hash", "event",
                     reason.alias("reason")).where(F.col("reason").isNotNull())


def entity_key(decoded: DataFrame) -> Column:
    """The single key of a reserve-family event (reserve or asset)."""
    cols = decoded.columns
    parts = [F.col(c) for c in ("asset", "reserve") if c in cols]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")

