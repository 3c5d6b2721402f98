"""DuckDB SQL oracles for the named queries.

Written independently of the Spark plans: the fixture adapters are restated
as SQL views, and folds use the plain per-pair window formulation (no block
buckets), so agreement checks both the adapters and the set-based fold.
"""

from __future__ import annotations

RAY = "CAST('1000000000000000000000000000' AS HUGEINT)"
E20 = "CAST('100000000000000000000' AS HUGEINT)"
E21 = "CAST('1000000000000000000000' AS HUGEINT)"
UNLISTED = 10 ** 9
ATOKEN_BASE, S_DEBT_BASE, STRATEGY_BASE = 10 ** 10, 2 * 10 ** 10, 3 * 10 ** 10


def addr(expr: str) -> str:
    return f"('0x' || lpad(lower(hex(CAST({expr} AS BIGINT))), 40, '0'))"


def txh(expr: str) -> str:
    return f"('0x' || lpad(lower(hex(CAST({expr} AS BIGINT))), 64, '0'))"


def asset(key: str) -> str:
    """The asset id a key names (the reserve of that part, or an unlisted asset)."""
    return f"(CAST({key} AS BIGINT) + CASE WHEN ({key}) % 50 >= 45 THEN {UNLISTED} ELSE 0 END)"


def atok(r: str) -> str:
    return addr(f"{ATOKEN_BASE} + 2 * {r}")


def vdebt(r: str) -> str:
    return addr(f"{ATOKEN_BASE + 1} + 2 * {r}")


def raydiv(a: str, i: str) -> str:
    return f"((CAST({a} AS HUGEINT) * {RAY} + CAST({i} AS HUGEINT) // 2) // CAST({i} AS HUGEINT))"


def ordk(b: str, l: str, leg: str = "0") -> str:
    return f"(CAST({b} AS HUGEINT) * {E20} + (CAST({l} AS HUGEINT) + 1) * 10 + {leg})"


def ok_block(k: str) -> str:
    return f"CAST({k} // {E20} AS BIGINT)"


def ok_log(k: str) -> str:
    return f"CAST(({k} % {E20}) // 10 - 1 AS BIGINT)"


# ------------------------------------------------------------- adapters

TOKEN_EVENTS = f"""
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax, l_discount,
         l_returnflag || l_linestatus AS kind,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS v,
         CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 5 AS inc,
         {asset('l_partkey % 50')} AS r
  FROM lineitem),
dd AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY l_partkey, l_suppkey, v, inc, l_quantity, l_tax, kind) AS rn
    FROM li) WHERE rn = 1),
tev AS (
  SELECT l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index,
         {txh('l_orderkey')} AS tx_hash, kind, r, l_partkey, l_suppkey, l_discount, v, inc,
         {addr('l_suppkey')} AS u,
         {addr('(l_suppkey * 7 + l_partkey) % 100')} AS peer,
         (l_suppkey * 7 + l_partkey) % 100 = l_suppkey AS self_tr,
         CAST({RAY} + CAST(l_partkey AS HUGEINT) * {E21} AS HUGEINT) AS idx,
         CASE WHEN kind IN ('RF', 'RO', 'AF') THEN {atok('r')}
              WHEN kind = 'AO' THEN {addr(0xA11CE)}
              ELSE {vdebt('r')} END AS emitter,
         CASE WHEN kind IN ('RF', 'NF') THEN 'Mint' WHEN kind IN ('RO', 'NO') THEN 'Burn'
              WHEN kind = 'AF' THEN 'BalanceTransfer'
              WHEN l_discount >= 0.05 THEN 'ReserveUsedAsCollateralEnabled'
              ELSE 'ReserveUsedAsCollateralDisabled' END AS event
  FROM dd)"""

RESERVES = f"""
res AS (
  SELECT {addr('p_partkey')} AS asset_address, p_partkey AS r, p_name, p_size, p_retailprice,
         {atok('p_partkey')} AS atoken_address,
         {vdebt('p_partkey')} AS v_debt_token_address
  FROM part)"""

TOKEN_MAP = """
tmap AS (
  SELECT atoken_address AS token, asset_address, 'atoken' AS token_type FROM res
  UNION ALL
  SELECT v_debt_token_address, asset_address, 'vdebt' FROM res)"""

RESOLVED = """
rtev AS (
  SELECT t.*, m.asset_address, m.token_type FROM tev t JOIN tmap m ON t.emitter = m.token
  WHERE t.event IN ('Mint', 'Burn', 'BalanceTransfer'))"""

LEGS = f"""
legs0 AS (
  SELECT u AS ua, asset_address AS aa, block_number, log_index, 0 AS leg,
         CASE WHEN v >= inc THEN {raydiv('v - inc', 'idx')} ELSE -{raydiv('inc - v', 'idx')} END AS d_s,
         CAST(0 AS HUGEINT) AS d_d, idx AS s_idx, CAST(NULL AS HUGEINT) AS d_idx,
         v >= inc AS is_up, CAST(NULL AS VARCHAR) AS clr, CAST(NULL AS BOOLEAN) AS toggle, false AS is_self
  FROM rtev WHERE token_type = 'atoken' AND event = 'Mint'
  UNION ALL
  SELECT u, asset_address, block_number, log_index, 0, -{raydiv('v + inc', 'idx')}, 0, idx, NULL,
         false, 'S', NULL, false
  FROM rtev WHERE token_type = 'atoken' AND event = 'Burn'
  UNION ALL
  SELECT u, asset_address, block_number, log_index, 0, -CAST(v AS HUGEINT), 0, NULL, NULL,
         false, 'S', NULL, false
  FROM rtev WHERE token_type = 'atoken' AND event = 'BalanceTransfer'
  UNION ALL
  SELECT peer, asset_address, block_number, log_index, 1, CAST(v AS HUGEINT), 0, idx, NULL,
         true, NULL, NULL, self_tr
  FROM rtev WHERE token_type = 'atoken' AND event = 'BalanceTransfer'
  UNION ALL
  SELECT u, asset_address, block_number, log_index, 0, 0,
         CASE WHEN v >= inc THEN {raydiv('v - inc', 'idx')} ELSE -{raydiv('inc - v', 'idx')} END,
         NULL, idx, v >= inc, NULL, NULL, false
  FROM rtev WHERE token_type = 'vdebt' AND event = 'Mint'
  UNION ALL
  SELECT u, asset_address, block_number, log_index, 0, 0, -{raydiv('v + inc', 'idx')}, NULL, idx,
         false, 'D', NULL, false
  FROM rtev WHERE token_type = 'vdebt' AND event = 'Burn'
  UNION ALL
  SELECT u, {addr('r')}, block_number, log_index, 0, 0, 0, NULL, NULL, false, NULL,
         l_discount >= 0.05, false
  FROM tev WHERE kind = 'AO'),
legs AS (SELECT *, {ordk('block_number', 'log_index', 'leg')} AS ok FROM legs0)"""


def ledger_ctes(extra_leg_filter: str = "") -> str:
    legs = LEGS
    if extra_leg_filter:
        legs = legs.replace("FROM legs0)", f"FROM legs0 WHERE {extra_leg_filter})")
    return "WITH " + ",".join([TOKEN_EVENTS, RESERVES, TOKEN_MAP, RESOLVED, legs])


FOLD_UNSEEDED = f"""
hdr AS (SELECT ua, aa, min(ok) FILTER (WHERE is_up) AS creation FROM legs GROUP BY ua, aa),
kl AS (
  SELECT l.*, h.creation, l.ok = h.creation AS is_creation
  FROM legs l JOIN hdr h USING (ua, aa)
  WHERE h.creation IS NOT NULL AND l.ok >= h.creation AND (NOT l.is_self OR l.ok = h.creation)),
rl AS (
  SELECT *, sum(d_s) OVER w AS run_s, sum(d_d) OVER w AS run_d FROM kl
  WINDOW w AS (PARTITION BY ua, aa ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ev AS (
  SELECT *,
    CASE WHEN toggle IS NOT NULL THEN toggle WHEN is_creation THEN false
         WHEN clr = 'S' AND run_s <= 0 THEN false END AS coll_ev,
    CASE WHEN is_up THEN true WHEN clr IS NOT NULL AND run_s <= 0 AND run_d <= 0 THEN false END AS act_ev,
    CASE WHEN is_creation THEN coalesce(s_idx, 0) ELSE s_idx END AS sidx_ev,
    CASE WHEN is_creation THEN coalesce(d_idx, 0) ELSE d_idx END AS didx_ev
  FROM rl),
fold AS (
  SELECT ua AS user_address, aa AS asset_address,
    CAST(sum(d_s) AS HUGEINT) AS scaled_atoken_balance,
    CAST(sum(d_d) AS HUGEINT) AS scaled_variable_debt,
    arg_max(coll_ev, ok) FILTER (WHERE coll_ev IS NOT NULL) AS use_as_collateral,
    CAST(arg_max(sidx_ev, ok) FILTER (WHERE sidx_ev IS NOT NULL) AS VARCHAR) AS atoken_last_index,
    CAST(arg_max(didx_ev, ok) FILTER (WHERE didx_ev IS NOT NULL) AS VARCHAR) AS debt_last_index,
    {ok_block('max(ok)')} AS last_updated_block,
    {ok_log('max(ok)')} AS last_updated_log_index,
    arg_max(act_ev, ok) FILTER (WHERE act_ev IS NOT NULL) AS is_active,
    {ok_block('min(creation)')} AS created_at_block
  FROM ev GROUP BY ua, aa)"""

SNAPSHOT = f"""
snap AS (
  SELECT {addr('s_suppkey')} AS ua, {addr('r')} AS aa,
         CAST((s_suppkey * 31 + r * 17) % 1000 * 100 AS HUGEINT) AS s0,
         CAST((s_suppkey * 13 + r * 29) % 700 * 100 AS HUGEINT) AS d0,
         (s_suppkey + r) % 2 = 0 AS coll0,
         CAST({RAY} + CAST(r AS HUGEINT) * {E21} AS HUGEINT) AS idx0
  FROM supplier, range(0, 45) t(r)
  WHERE (s_suppkey * 31 + r * 17) % 1000 > 0 OR (s_suppkey * 13 + r * 29) % 700 > 0)"""

# Seeded fold: seeded pairs ignore creation; legs at or before (5000, -1) are
# stale (only their clear step acts, on the seed balances).
FOLD_SEEDED = f"""
sl AS (
  SELECT l.*, s.s0, s.d0, s.coll0, s.idx0,
         (l.block_number < 5000) AS pre
  FROM legs l JOIN snap s USING (ua, aa)),
skl AS (SELECT * FROM sl WHERE NOT pre AND NOT is_self),
srl AS (
  SELECT *, s0 + sum(d_s) OVER w AS run_s, d0 + sum(d_d) OVER w AS run_d FROM skl
  WINDOW w AS (PARTITION BY ua, aa ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sev AS (
  SELECT *,
    CASE WHEN toggle IS NOT NULL THEN toggle WHEN clr = 'S' AND run_s <= 0 THEN false END AS coll_ev,
    CASE WHEN is_up THEN true WHEN clr IS NOT NULL AND run_s <= 0 AND run_d <= 0 THEN false END AS act_ev
  FROM srl),
sagg AS (
  SELECT ua, aa, sum(d_s) AS sum_s, sum(d_d) AS sum_d,
    arg_max(coll_ev, ok) FILTER (WHERE coll_ev IS NOT NULL) AS coll,
    arg_max(act_ev, ok) FILTER (WHERE act_ev IS NOT NULL) AS act,
    arg_max(s_idx, ok) FILTER (WHERE s_idx IS NOT NULL) AS sidx,
    arg_max(d_idx, ok) FILTER (WHERE d_idx IS NOT NULL) AS didx,
    max(ok) AS last_ok
  FROM sev GROUP BY ua, aa),
stale AS (
  SELECT ua, aa, bool_or(clr = 'S') AS any_scs, bool_or(clr IS NOT NULL) AS any_sc
  FROM sl WHERE pre GROUP BY ua, aa),
seeded AS (
  SELECT s.ua AS user_address, s.aa AS asset_address,
    CAST(s.s0 + coalesce(a.sum_s, 0) AS HUGEINT) AS scaled_atoken_balance,
    CAST(s.d0 + coalesce(a.sum_d, 0) AS HUGEINT) AS scaled_variable_debt,
    coalesce(a.coll, CASE WHEN st.any_scs AND s.s0 <= 0 THEN false END, s.coll0) AS use_as_collateral,
    CAST(coalesce(a.sidx, s.idx0) AS VARCHAR) AS atoken_last_index,
    CAST(coalesce(a.didx, s.idx0) AS VARCHAR) AS debt_last_index,
    CASE WHEN a.last_ok IS NULL THEN 5000 ELSE {ok_block('a.last_ok')} END AS last_updated_block,
    CASE WHEN a.last_ok IS NULL THEN -1 ELSE {ok_log('a.last_ok')} END AS last_updated_log_index,
    coalesce(a.act, CASE WHEN st.any_sc AND s.s0 <= 0 AND s.d0 <= 0 THEN false END, true) AS is_active,
    CAST(5000 AS BIGINT) AS created_at_block
  FROM snap s LEFT JOIN sagg a USING (ua, aa) LEFT JOIN stale st USING (ua, aa)),
ulegs AS (SELECT l.* FROM legs l ANTI JOIN snap s USING (ua, aa)),
uhdr AS (SELECT ua, aa, min(ok) FILTER (WHERE is_up) AS creation FROM ulegs GROUP BY ua, aa),
ukl AS (
  SELECT l.*, h.creation, l.ok = h.creation AS is_creation
  FROM ulegs l JOIN uhdr h USING (ua, aa)
  WHERE h.creation IS NOT NULL AND l.ok >= h.creation AND (NOT l.is_self OR l.ok = h.creation)),
url AS (
  SELECT *, sum(d_s) OVER w AS run_s, sum(d_d) OVER w AS run_d FROM ukl
  WINDOW w AS (PARTITION BY ua, aa ORDER BY ok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
uev AS (
  SELECT *,
    CASE WHEN toggle IS NOT NULL THEN toggle WHEN is_creation THEN false
         WHEN clr = 'S' AND run_s <= 0 THEN false END AS coll_ev,
    CASE WHEN is_up THEN true WHEN clr IS NOT NULL AND run_s <= 0 AND run_d <= 0 THEN false END AS act_ev,
    CASE WHEN is_creation THEN coalesce(s_idx, 0) ELSE s_idx END AS sidx_ev,
    CASE WHEN is_creation THEN coalesce(d_idx, 0) ELSE d_idx END AS didx_ev
  FROM url),
unseeded AS (
  SELECT ua AS user_address, aa AS asset_address,
    CAST(sum(d_s) AS HUGEINT) AS scaled_atoken_balance,
    CAST(sum(d_d) AS HUGEINT) AS scaled_variable_debt,
    arg_max(coll_ev, ok) FILTER (WHERE coll_ev IS NOT NULL) AS use_as_collateral,
    CAST(arg_max(sidx_ev, ok) FILTER (WHERE sidx_ev IS NOT NULL) AS VARCHAR) AS atoken_last_index,
    CAST(arg_max(didx_ev, ok) FILTER (WHERE didx_ev IS NOT NULL) AS VARCHAR) AS debt_last_index,
    {ok_block('max(ok)')} AS last_updated_block,
    {ok_log('max(ok)')} AS last_updated_log_index,
    arg_max(act_ev, ok) FILTER (WHERE act_ev IS NOT NULL) AS is_active,
    {ok_block('min(creation)')} AS created_at_block
  FROM uev GROUP BY ua, aa)"""

POSITION_COLS = ("user_address, asset_address, scaled_atoken_balance, scaled_variable_debt, "
                 "use_as_collateral, atoken_last_index, debt_last_index, last_updated_block, "
                 "last_updated_log_index, is_active, created_at_block")

SQL: dict[str, str] = {}

SQL["fold_positions"] = ledger_ctes() + "," + FOLD_UNSEEDED + f"\nSELECT {POSITION_COLS} FROM fold"

SQL["position_balances"] = ledger_ctes() + "," + FOLD_UNSEEDED + \
    "\nSELECT user_address, asset_address, scaled_atoken_balance, scaled_variable_debt FROM fold"

SQL["state_as_of"] = ledger_ctes("block_number <= 7500") + "," + FOLD_UNSEEDED + \
    f"\nSELECT {POSITION_COLS} FROM fold"

ANCHORS = """
anchors AS (
  SELECT DISTINCT (SELECT max(l_orderkey) FROM lineitem) * k // 8 AS anchor FROM range(1, 9) t(k))"""

# every anchor folds its own copy of the legs up to it
SQL["states_as_of"] = "WITH " + ",".join([TOKEN_EVENTS, RESERVES, TOKEN_MAP, RESOLVED, ANCHORS, LEGS.replace(
    "FROM legs0)", "FROM (SELECT l.* REPLACE (ua || '@' || anchor AS ua) FROM legs0 l JOIN anchors ON block_number <= anchor))"),
    FOLD_UNSEEDED]) + f"""
SELECT {POSITION_COLS}, CAST(anchor AS BIGINT) AS anchor
FROM (SELECT * REPLACE (split_part(user_address, '@', 1) AS user_address), split_part(user_address, '@', 2) AS anchor FROM fold)"""

SQL["fold_positions_seeded"] = ledger_ctes() + "," + SNAPSHOT + "," + FOLD_SEEDED + \
    f"\nSELECT {POSITION_COLS} FROM seeded UNION ALL SELECT {POSITION_COLS} FROM unseeded"

SQL["running_balance"] = ledger_ctes() + "," + FOLD_UNSEEDED + """
SELECT ua AS user_address, aa AS asset_address, block_number, log_index, leg,
       CAST(run_s AS HUGEINT) AS running_supply, CAST(run_d AS HUGEINT) AS running_debt FROM rl"""

SQL["position_legs"] = ledger_ctes() + """
SELECT ua AS user_address, aa AS asset_address, block_number, log_index, leg,
       CAST(d_s AS HUGEINT) AS d_supply, CAST(d_d AS HUGEINT) AS d_debt, is_up, clr AS clear,
       toggle, is_self FROM legs"""

SQL["touched_pairs"] = ledger_ctes() + """
SELECT DISTINCT user_address, asset_address FROM (
  SELECT u AS user_address, asset_address FROM rtev WHERE event IN ('Mint', 'Burn', 'BalanceTransfer')
  UNION ALL SELECT peer, asset_address FROM rtev WHERE event = 'BalanceTransfer')
WHERE user_address <> '0x0000000000000000000000000000000000000000'"""

SQL["first_delivery"] = "WITH " + TOKEN_EVENTS + f""",
x AS (SELECT *, kind = 'AO' AS coll FROM tev)
SELECT tx_hash, log_index, block_number, emitter AS address, event,
  CASE WHEN NOT coll THEN u END AS from_address,
  CASE WHEN coll THEN NULL WHEN kind = 'AF' THEN peer ELSE u END AS to_address,
  CASE WHEN NOT coll THEN v END AS value,
  CASE WHEN NOT coll AND kind <> 'AF' THEN inc END AS balance_increase,
  CASE WHEN coll THEN {addr('r')} END AS reserve,
  CASE WHEN coll THEN u END AS user_address,
  CASE WHEN coll THEN l_discount >= 0.05 END AS enabled
FROM x"""

SQL["resolve_token"] = ledger_ctes() + """
SELECT tx_hash, log_index, emitter AS address, asset_address, token_type FROM rtev"""

SQL["ray_div"] = "WITH " + TOKEN_EVENTS + f"""
SELECT tx_hash, log_index, CAST({raydiv('v', 'idx')} AS BIGINT) AS scaled_value
FROM tev WHERE kind <> 'AO'"""

SQL["mint_delta"] = "WITH " + TOKEN_EVENTS + f"""
SELECT tx_hash, log_index, v >= inc AS is_increase,
  CAST(CASE WHEN v >= inc THEN {raydiv('v - inc', 'idx')} ELSE -{raydiv('inc - v', 'idx')} END AS BIGINT) AS delta
FROM tev WHERE event = 'Mint'"""

SQL["burn_delta"] = "WITH " + TOKEN_EVENTS + f"""
SELECT tx_hash, log_index, CAST({raydiv('v + inc', 'idx')} AS BIGINT) AS delta
FROM tev WHERE event = 'Burn'"""


# ------------------------------------------------------------- raw logs

from ..functions.text import PROVIDER_PATTERNS, RETRYABLE_PATTERNS  # noqa: E402
from ..functions.topics import EVENTS, TOPIC  # noqa: E402

POOL = addr(0xA11CE)
CONFIGURATOR = addr(0xA11CF)
ZERO = "'0x0000000000000000000000000000000000000000'"

TOPIC_DIM = "topic_dim(event, family, topic0) AS (VALUES " + ", ".join(
    f"('{n}', '{f}', '{TOPIC[n]}')" for n, _, f in EVENTS) + ")"

EVX = f"""
evx AS (
  SELECT event_id, event_type, user_id, value,
         CAST(floor(epoch(ts) / 12) AS BIGINT) AS block_number,
         CAST(event_id AS BIGINT) AS log_index,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS amount,
         {asset('user_id % 50')} AS r
  FROM events)"""

CFG = f"""
cfg AS (
  SELECT block_number, log_index, {txh('event_id')} AS tx_hash, {addr('r')} AS asset, r, k, amount,
    CASE WHEN event_type = 'purchase' THEN 'SupplyCapChanged'
         WHEN event_type = 'signup' AND k % 2 = 0 THEN 'ReserveFrozen'
         WHEN event_type = 'signup' THEN 'ReserveUnfrozen'
         WHEN event_type = 'view' THEN 'ReservePaused'
         WHEN event_type = 'click' THEN 'CollateralConfigurationChanged'
         WHEN event_type = 'error' THEN 'ReserveDataUpdated' END AS event,
    event_type
  FROM evx)"""

EMA = f"""
ema AS (
  SELECT block_number, log_index + 1000000 AS log_index, {txh('event_id')} AS tx_hash,
    {addr('r')} AS asset, r, CAST(k % 8 AS INTEGER) AS category_id, event_id % 2 = 1 AS flag,
    log_index AS raw_log,
    CASE event_type WHEN 'click' THEN 'collateral' WHEN 'view' THEN 'borrowable' ELSE 'ltvzero' END AS bitmap,
    CASE event_type WHEN 'click' THEN 'AssetCollateralInEModeChanged'
                    WHEN 'view' THEN 'AssetBorrowableInEModeChanged'
                    ELSE 'AssetLtvzeroInEModeChanged' END AS event
  FROM evx WHERE event_type IN ('click', 'view', 'signup'))"""

CAT = f"""
cat AS (
  SELECT block_number, log_index + 2000000 AS log_index, log_index AS raw_log, {txh('event_id')} AS tx_hash,
    CAST(k % 8 AS INTEGER) AS category_id, 9000 + k AS ltv, 9300 + k AS liquidation_threshold,
    10100 + k AS liquidation_bonus, {addr('5000 + k % 8')} AS oracle,
    'category-' || CAST(k % 8 AS VARCHAR) || '-v' || CAST(event_id % 3 AS VARCHAR) AS label
  FROM evx WHERE event_type = 'purchase')"""

UE = f"""
ue AS (
  SELECT datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS block_number,
    CAST(o_orderkey AS BIGINT) AS log_index, {txh('o_orderkey')} AS tx_hash,
    {addr('o_custkey')} AS user_address,
    CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS INTEGER) AS category_id
  FROM orders)"""

RAW_TOKEN = f"""
rawtok AS (
  SELECT l_orderkey AS block_number, CAST(l_linenumber AS BIGINT) AS log_index,
    {txh('l_orderkey')} AS tx_hash, l_quantity, l_returnflag || l_linestatus AS kind,
    CASE WHEN l_returnflag || l_linestatus IN ('RF', 'RO', 'AF') THEN {atok(asset('l_partkey % 50'))}
         WHEN l_returnflag || l_linestatus = 'AO' THEN {POOL}
         ELSE {vdebt(asset('l_partkey % 50'))} END AS address,
    CASE WHEN l_returnflag || l_linestatus IN ('RF', 'NF') THEN 'Mint'
         WHEN l_returnflag || l_linestatus IN ('RO', 'NO') THEN 'Burn'
         WHEN l_returnflag || l_linestatus = 'AF' THEN 'BalanceTransfer'
         WHEN l_discount >= 0.05 THEN 'ReserveUsedAsCollateralEnabled'
         ELSE 'ReserveUsedAsCollateralDisabled' END AS event
  FROM lineitem)"""

RAW_ALL = f"""
rawall AS (
  SELECT address, block_number, log_index, tx_hash, event,
    l_quantity = 49 AS no_topics, l_quantity = 50 AND kind <> 'AO' AS malformed
  FROM rawtok
  UNION ALL
  SELECT CASE WHEN event = 'ReserveDataUpdated' THEN {POOL} ELSE {CONFIGURATOR} END,
    block_number, log_index, tx_hash, event, false, false FROM cfg
  UNION ALL SELECT {CONFIGURATOR}, block_number, log_index, tx_hash, event, false, false FROM ema
  UNION ALL SELECT {CONFIGURATOR}, block_number, log_index, tx_hash, 'EModeCategoryAdded', false, false FROM cat
  UNION ALL SELECT {POOL}, block_number, log_index, tx_hash, 'UserEModeSet', false, false FROM ue)"""


def raw_ctes() -> str:
    return "WITH " + ",".join([TOPIC_DIM, EVX, CFG, EMA, CAT, UE, RAW_TOKEN, RAW_ALL])


SQL["tracked_addresses"] = "WITH " + RESERVES + f"""
SELECT DISTINCT address FROM (
  SELECT atoken_address AS address FROM res UNION ALL SELECT v_debt_token_address FROM res
  UNION ALL SELECT {POOL} UNION ALL SELECT {CONFIGURATOR})"""

SQL["scan_logs"] = raw_ctes() + "," + RESERVES + f""",
tracked AS (
  SELECT atoken_address AS address FROM res UNION ALL SELECT v_debt_token_address FROM res
  UNION ALL SELECT {POOL} UNION ALL SELECT {CONFIGURATOR})
SELECT r.address, r.block_number, r.log_index, r.tx_hash, t.topic0
FROM rawall r JOIN topic_dim t ON r.event = t.event
WHERE NOT r.no_topics AND r.block_number BETWEEN 1000 AND 12000
  AND r.address IN (SELECT address FROM tracked)"""

SQL["tracked_topics"] = raw_ctes() + """
SELECT t.event, t.family, t.topic0, count(*) AS n_logs
FROM rawall r JOIN topic_dim t ON r.event = t.event
WHERE NOT r.no_topics GROUP BY t.event, t.family, t.topic0"""

SQL["confirmation_lag"] = "WITH " + RAW_TOKEN + """
SELECT tx_hash, log_index, block_number FROM rawtok
WHERE block_number <= (SELECT max(block_number) FROM rawtok) - 20"""

SQL["route_events"] = raw_ctes() + """
SELECT r.tx_hash, r.log_index, r.event, t.family
FROM rawall r JOIN topic_dim t ON r.event = t.event WHERE NOT r.no_topics"""

SQL["decode_token_events"] = "WITH " + TOKEN_EVENTS.replace(
    "FROM lineitem),", "FROM lineitem),", 1) + f""",
y AS (
  SELECT l.*, l.l_returnflag || l.l_linestatus AS kind2 FROM lineitem l)
SELECT {txh('l_orderkey')} AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index,
  l_orderkey AS block_number,
  CASE WHEN kind2 IN ('RF', 'RO', 'AF') THEN {atok(asset('l_partkey % 50'))}
       WHEN kind2 = 'AO' THEN {POOL} ELSE {vdebt(asset('l_partkey % 50'))} END AS address,
  CASE WHEN kind2 IN ('RF', 'NF') THEN 'Mint' WHEN kind2 IN ('RO', 'NO') THEN 'Burn'
       WHEN kind2 = 'AF' THEN 'BalanceTransfer'
       WHEN l_discount >= 0.05 THEN 'ReserveUsedAsCollateralEnabled'
       ELSE 'ReserveUsedAsCollateralDisabled' END AS event,
  CASE WHEN kind2 <> 'AO' THEN {addr('l_suppkey')} END AS from_address,
  CASE WHEN kind2 = 'AO' THEN NULL WHEN kind2 = 'AF' THEN {addr('(l_suppkey * 7 + l_partkey) % 100')}
       ELSE {addr('l_suppkey')} END AS to_address,
  CASE WHEN kind2 <> 'AO' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END AS value,
  CASE WHEN kind2 NOT IN ('AO', 'AF') THEN
    CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 5 END
    AS balance_increase,
  CASE WHEN kind2 = 'AO' THEN {addr(asset('l_partkey % 50'))} END AS reserve,
  CASE WHEN kind2 = 'AO' THEN {addr('l_suppkey')} END AS user_address
FROM y WHERE NOT (l_quantity = 49 OR (l_quantity = 50 AND kind2 <> 'AO'))"""

SQL["decode_reserve_events"] = "WITH " + ",".join([EVX, CFG, EMA, CAT]) + """
SELECT tx_hash, log_index, block_number, event, asset,
  CASE WHEN event = 'SupplyCapChanged' THEN amount END AS new_amount,
  CASE WHEN event = 'ReservePaused' THEN k % 2 = 0 END AS flag,
  CASE WHEN event = 'CollateralConfigurationChanged' THEN amount END AS ltv,
  CASE WHEN event = 'CollateralConfigurationChanged' THEN amount + 500 END AS liquidation_threshold,
  CASE WHEN event = 'CollateralConfigurationChanged' THEN k + 10000 END AS liquidation_bonus,
  CASE WHEN event = 'ReserveDataUpdated' THEN amount END AS liquidity_rate,
  CASE WHEN event = 'ReserveDataUpdated' THEN amount * 2 END AS stable_borrow_rate,
  CASE WHEN event = 'ReserveDataUpdated' THEN amount * 3 END AS variable_borrow_rate,
  CASE WHEN event = 'ReserveDataUpdated' THEN k + 1000000 END AS liquidity_index,
  CASE WHEN event = 'ReserveDataUpdated' THEN 2 * k + 1000000 END AS variable_borrow_index,
  CAST(NULL AS INTEGER) AS category_id, CAST(NULL AS VARCHAR) AS oracle, CAST(NULL AS VARCHAR) AS label
FROM cfg
UNION ALL
SELECT tx_hash, log_index, block_number, event, asset, NULL, flag, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, category_id, NULL, NULL FROM ema
UNION ALL
SELECT tx_hash, log_index, block_number, 'EModeCategoryAdded', NULL, NULL, NULL, ltv,
  liquidation_threshold, liquidation_bonus, NULL, NULL, NULL, NULL, NULL, category_id, oracle, label
FROM cat"""

SQL["decode_emode_events"] = "WITH " + UE + """
SELECT tx_hash, log_index, block_number, user_address, category_id FROM ue"""

SQL["decode_rejects"] = raw_ctes() + """
SELECT tx_hash, log_index, CASE WHEN no_topics THEN NULL ELSE event END AS event,
  CASE WHEN no_topics THEN 'no_topics' ELSE 'malformed' END AS reason
FROM rawall WHERE no_topics OR malformed"""

SQL["word_to_uint"] = "WITH " + TOKEN_EVENTS.replace(
    "WHERE rn = 1", "WHERE rn >= 1") + """
SELECT tx_hash, log_index, CAST(v AS VARCHAR) AS word0,
  CASE WHEN kind = 'AF' THEN CAST(idx AS VARCHAR) ELSE CAST(inc AS VARCHAR) END AS word1
FROM tev WHERE kind <> 'AO'"""

SQL["config_bit"] = f"""
SELECT {addr(asset('p_partkey'))} AS asset_address, p_partkey % 3 = 0 AS is_paused
FROM part"""

SQL["normalize_address"] = """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL
  ELSE '0x' || lpad(lower(hex(c_custkey)), 40, '0') END AS address FROM customer"""

# ------------------------------------------------------------- dedup table

SQL["insert_if_absent"] = f"""
SELECT DISTINCT {txh('l_orderkey')} AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index,
  l_orderkey AS block_number FROM lineitem"""

SQL["new_deliveries"] = f"""
SELECT DISTINCT {txh('l_orderkey')} AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index,
  l_orderkey AS block_number FROM lineitem WHERE l_orderkey >= 7500"""

SQL["delete_older_than"] = f"""
SELECT DISTINCT {txh('l_orderkey')} AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index,
  l_orderkey AS block_number FROM lineitem
WHERE l_orderkey >= (SELECT max(l_orderkey) FROM lineitem) - 100"""

SQL["logs_per_range"] = """
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) * 10 AS range_start, count(*) AS n_logs,
  CASE WHEN count(*) > 1000 THEN 'halve' WHEN count(*) < 250 THEN 'double' ELSE 'keep' END AS chunk_action
FROM lineitem GROUP BY 1"""

# ------------------------------------------------------------- reserves

RES_FULL = f"""
resf AS (
  SELECT {addr('p_partkey')} AS asset_address, p_name AS symbol, CAST(p_size AS BIGINT) AS decimals,
    CAST(p_partkey AS INTEGER) AS reserve_id, CAST(8500 AS BIGINT) AS liquidation_threshold,
    CAST(10500 AS BIGINT) AS liquidation_bonus, CAST(8000 AS BIGINT) AS ltv, true AS is_active,
    false AS is_frozen, false AS is_paused, true AS is_borrowing_enabled, false AS is_dropped,
    CAST(round(p_retailprice * 100) AS BIGINT) AS supply_cap, CAST(500000 AS BIGINT) AS borrow_cap,
    CAST(1000 AS BIGINT) AS reserve_factor, true AS is_collateral_enabled,
    false AS is_stable_borrow_enabled, true AS is_flash_loan_enabled, CAST(0 AS BIGINT) AS debt_ceiling,
    CAST(1000 AS BIGINT) AS liquidation_protocol_fee, false AS is_siloed_borrowing,
    CAST(0 AS BIGINT) AS unbacked_mint_cap,
    {atok('p_partkey')} AS atoken_address, {vdebt('p_partkey')} AS v_debt_token_address,
    {addr(3)} AS s_debt_token_address, {addr(4)} AS interest_rate_strategy_address,
    CAST(0 AS BIGINT) AS last_updated_block, CAST(-1 AS BIGINT) AS last_updated_log_index
  FROM part)"""

RESERVE_COLS = ["asset_address", "symbol", "decimals", "reserve_id", "liquidation_threshold",
                "liquidation_bonus", "ltv", "is_active", "is_frozen", "is_paused",
                "is_borrowing_enabled", "is_dropped", "supply_cap", "borrow_cap", "reserve_factor",
                "is_collateral_enabled", "is_stable_borrow_enabled", "is_flash_loan_enabled",
                "debt_ceiling", "liquidation_protocol_fee", "is_siloed_borrowing",
                "unbacked_mint_cap", "atoken_address", "v_debt_token_address",
                "s_debt_token_address", "interest_rate_strategy_address", "last_updated_block",
                "last_updated_log_index"]

SQL["fold_reserves"] = "WITH " + ",".join([EVX, CFG, RES_FULL]) + f""",
ce AS (
  SELECT c.*, {ordk('block_number', 'log_index')} AS ok FROM cfg c
  WHERE event IN ('SupplyCapChanged', 'ReserveFrozen', 'ReserveUnfrozen', 'ReservePaused',
                  'CollateralConfigurationChanged')
    AND asset IN (SELECT asset_address FROM resf)),
agg AS (
  SELECT asset,
    arg_max(amount, ok) FILTER (WHERE event = 'SupplyCapChanged') AS supply_cap,
    arg_max(event = 'ReserveFrozen', ok) FILTER (WHERE event IN ('ReserveFrozen', 'ReserveUnfrozen')) AS is_frozen,
    arg_max(k % 2 = 0, ok) FILTER (WHERE event = 'ReservePaused') AS is_paused,
    arg_max(amount, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS ltv,
    arg_max(amount + 500, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS liquidation_threshold,
    arg_max(k + 10000, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS liquidation_bonus,
    max(ok) AS last_ok
  FROM ce GROUP BY asset)
SELECT r.asset_address, r.symbol, r.decimals, r.reserve_id,
  coalesce(a.liquidation_threshold, r.liquidation_threshold) AS liquidation_threshold,
  coalesce(a.liquidation_bonus, r.liquidation_bonus) AS liquidation_bonus,
  coalesce(a.ltv, r.ltv) AS ltv, r.is_active, coalesce(a.is_frozen, r.is_frozen) AS is_frozen,
  coalesce(a.is_paused, r.is_paused) AS is_paused, r.is_borrowing_enabled, r.is_dropped,
  coalesce(a.supply_cap, r.supply_cap) AS supply_cap, r.borrow_cap, r.reserve_factor,
  r.is_collateral_enabled, r.is_stable_borrow_enabled, r.is_flash_loan_enabled, r.debt_ceiling,
  r.liquidation_protocol_fee, r.is_siloed_borrowing, r.unbacked_mint_cap, r.atoken_address,
  r.v_debt_token_address, r.s_debt_token_address, r.interest_rate_strategy_address,
  coalesce({ok_block('a.last_ok')}, r.last_updated_block) AS last_updated_block,
  coalesce({ok_log('a.last_ok')}, r.last_updated_log_index) AS last_updated_log_index
FROM resf r LEFT JOIN agg a ON r.asset_address = a.asset"""

SQL["fold_reserve_state"] = "WITH " + ",".join([EVX, CFG, RES_FULL]) + f""",
ce AS (
  SELECT c.*, {ordk('block_number', 'log_index')} AS ok FROM cfg c
  WHERE event = 'ReserveDataUpdated' AND asset IN (SELECT asset_address FROM resf)),
agg AS (
  SELECT asset, arg_max(k + 1000000, ok) AS li, arg_max(2 * k + 1000000, ok) AS vi,
    arg_max(amount, ok) AS lr, arg_max(amount * 3, ok) AS vr, arg_max(amount * 2, ok) AS sr,
    max(ok) AS last_ok
  FROM ce GROUP BY asset)
SELECT r.asset_address, coalesce(a.li, 1) AS liquidity_index, coalesce(a.vi, 1) AS variable_borrow_index,
  coalesce(a.lr, 0) AS current_liquidity_rate, coalesce(a.vr, 0) AS current_variable_borrow_rate,
  coalesce(a.sr, 0) AS current_stable_borrow_rate, 0 AS total_liquidity, 0 AS total_variable_debt,
  0 AS total_stable_debt, 0 AS accrued_to_treasury, 0 AS unbacked, 0 AS isolation_mode_total_debt,
  coalesce({ok_block('a.last_ok')}, 0) AS last_updated_block,
  coalesce({ok_log('a.last_ok')}, -1) AS last_updated_log_index
FROM resf r LEFT JOIN agg a ON r.asset_address = a.asset"""

SQL["guard_newer"] = "WITH " + UE + f""",
st AS (
  SELECT user_address, max({ordk('block_number', 'log_index')}) AS sok
  FROM ue WHERE block_number < 10000 GROUP BY user_address)
SELECT u.user_address, u.block_number, u.log_index, u.category_id
FROM ue u LEFT JOIN st s USING (user_address)
WHERE s.sok IS NULL OR {ordk('u.block_number', 'u.log_index')} > s.sok"""

USER_EMODE_FOLD = f"""
uef AS (
  SELECT user_address, arg_max(category_id, ok) AS emode_category_id, max(ok) AS last_ok
  FROM (SELECT *, {ordk('block_number', 'log_index')} AS ok FROM ue) GROUP BY user_address)"""

SQL["fold_user_emode"] = "WITH " + UE + "," + USER_EMODE_FOLD + f"""
SELECT user_address, emode_category_id, {ok_block('last_ok')} AS last_updated_block,
  {ok_log('last_ok')} AS last_updated_log_index FROM uef"""

SQL["active_emode_users"] = SQL["fold_user_emode"] + " WHERE emode_category_id > 0"

SNAP_RES = f"""
snapres AS (
  SELECT {addr(asset('p_partkey'))} AS asset_address,
    CASE WHEN p_partkey % 5 = 0 THEN 'UNKNOWN' ELSE p_name END AS symbol,
    CAST(p_size AS BIGINT) AS decimals, CAST(p_partkey AS INTEGER) AS reserve_id,
    7000 + p_partkey AS ltv, 7500 + p_partkey AS liquidation_threshold, 10500 + p_partkey AS liquidation_bonus,
    p_partkey % 9 <> 8 AS is_active, p_partkey % 11 = 10 AS is_frozen, p_partkey % 3 = 0 AS is_paused,
    p_partkey % 2 = 1 AS is_borrowing_enabled, false AS is_dropped,
    CAST(round(p_retailprice * 100) AS BIGINT) AS supply_cap,
    CAST(round(p_retailprice * 50) AS BIGINT) AS borrow_cap, CAST(1000 AS BIGINT) AS reserve_factor,
    p_partkey % 4 <> 1 AS is_collateral_enabled, false AS is_stable_borrow_enabled,
    CASE WHEN p_partkey % 7 = 0 THEN true ELSE p_partkey % 2 = 0 END AS is_flash_loan_enabled,
    CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 1000 END AS debt_ceiling,
    CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 10 END AS liquidation_protocol_fee,
    CASE WHEN p_partkey % 7 = 0 THEN false ELSE p_partkey % 2 = 1 END AS is_siloed_borrowing,
    CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 100 END AS unbacked_mint_cap,
    {atok(asset('p_partkey'))} AS atoken_address, {vdebt(asset('p_partkey'))} AS v_debt_token_address,
    CASE WHEN p_partkey % 2 = 0 THEN {ZERO} ELSE {addr(str(S_DEBT_BASE) + ' + ' + asset('p_partkey'))} END AS s_debt_token_address,
    {addr(str(STRATEGY_BASE) + ' + ' + asset('p_partkey'))} AS interest_rate_strategy_address,
    CAST(5000 AS BIGINT) AS last_updated_block, CAST(-1 AS BIGINT) AS last_updated_log_index,
    p_partkey AS r, p_size, p_retailprice
  FROM part)"""

SQL["load_reserve_snapshot"] = "WITH " + SNAP_RES + "\nSELECT " + ", ".join(RESERVE_COLS) + " FROM snapres"

SQL["load_reserve_state_snapshot"] = "WITH " + SNAP_RES + f"""
SELECT asset_address,
  CAST({RAY} + CAST(r AS HUGEINT) * {E21} AS VARCHAR) AS liquidity_index,
  CAST({RAY} + CAST(2 * r AS HUGEINT) * {E21} AS VARCHAR) AS variable_borrow_index,
  p_size * 1000 AS current_liquidity_rate, p_size * 3000 AS current_variable_borrow_rate,
  p_size * 5000 AS current_stable_borrow_rate,
  CAST(round(p_retailprice * 1000) AS BIGINT) AS total_liquidity,
  CAST(round(p_retailprice * 400) AS BIGINT) AS total_variable_debt,
  CASE WHEN r % 2 = 0 THEN 0 ELSE CAST(round(p_retailprice * 7) AS BIGINT) END AS total_stable_debt,
  r * 11 AS accrued_to_treasury, 0 AS unbacked, r * 13 AS isolation_mode_total_debt,
  last_updated_block, last_updated_log_index
FROM snapres"""

SQL["merge_overwrite"] = "WITH " + SNAP_RES + "," + RES_FULL + "\nSELECT " + ", ".join(
    [f"CASE WHEN e.asset_address IS NOT NULL THEN e.{c} ELSE n.{c} END AS {c}"
     if c.startswith("last_updated") else f"CASE WHEN n.asset_address IS NOT NULL THEN n.{c} ELSE e.{c} END AS {c}"
     for c in RESERVE_COLS]) + \
    "\nFROM snapres n FULL OUTER JOIN resf e ON n.asset_address = e.asset_address"

SQL["known_reserves"] = "WITH " + ",".join([EVX, CFG]) + """
SELECT tx_hash, log_index, asset FROM cfg WHERE r < 45"""

SQL["missing_reserves"] = "WITH " + ",".join([EVX, CFG]) + """
SELECT asset AS asset_address, min(block_number) AS first_block, count(*) AS n_events
FROM cfg WHERE r >= 45 GROUP BY asset"""

SQL["count_by_key"] = "WITH " + ",".join([EVX, CFG]) + """
SELECT asset, CASE WHEN r < 45 THEN 1 ELSE 0 END AS n_rows FROM (SELECT DISTINCT asset, r FROM cfg)"""

# ------------------------------------------------------------- eMode

CAT_FOLD = f"""
catf AS (
  SELECT category_id, arg_max(ltv, ok) AS ltv, arg_max(liquidation_threshold, ok) AS liquidation_threshold,
    arg_max(liquidation_bonus, ok) AS liquidation_bonus, arg_max(oracle, ok) AS oracle,
    arg_max(label, ok) AS label, max(ok) AS last_ok
  FROM (SELECT *, {ordk('block_number', 'raw_log')} AS ok FROM cat) GROUP BY category_id)"""

SQL["fold_categories"] = "WITH " + ",".join([EVX, CAT, CAT_FOLD]) + f"""
SELECT category_id, ltv, liquidation_threshold, liquidation_bonus, oracle, label,
  {ok_block('last_ok')} AS last_updated_block, {ok_log('last_ok')} AS last_updated_log_index FROM catf"""

FLAGS = f"""
flags AS (
  SELECT category_id, asset, bitmap, r,
    arg_max(flag, {ordk('block_number', 'raw_log')}) AS flag
  FROM ema GROUP BY category_id, asset, bitmap, r),
members AS (SELECT category_id, bitmap, CAST(r AS INTEGER) AS reserve_id, flag FROM flags WHERE r < 45)"""


def _bm(b: str) -> str:
    lo = f"bit_or(CASE WHEN flag AND bitmap = '{b}' AND reserve_id < 64 THEN CAST(1 AS BIGINT) << reserve_id END)"
    hi = f"bit_or(CASE WHEN flag AND bitmap = '{b}' AND reserve_id >= 64 THEN CAST(1 AS BIGINT) << (reserve_id - 64) END)"
    return (f"'0x' || lpad(lower(hex(coalesce({hi}, 0))), 16, '0') || "
            f"lpad(lower(hex(coalesce({lo}, 0))), 16, '0') AS {b}_bitmap, "
            f"count(*) FILTER (WHERE flag AND bitmap = '{b}') AS {b}_members")


SQL["fold_bitmaps"] = "WITH " + ",".join([EVX, EMA, FLAGS]) + f"""
SELECT category_id, {_bm('collateral')}, {_bm('borrowable')}, {_bm('ltvzero')}
FROM members GROUP BY category_id"""

SQL["bitmap_members"] = "WITH " + ",".join([EVX, EMA, FLAGS]) + """
SELECT category_id, bitmap, reserve_id FROM members WHERE flag"""

SQL["missing_categories"] = "WITH " + ",".join([EVX, EMA, CAT]) + """
SELECT category_id + 4 AS category_id, min(block_number) AS first_block, count(*) AS n_events
FROM ema WHERE category_id + 4 NOT IN (SELECT DISTINCT category_id FROM cat)
GROUP BY category_id + 4"""

SQL["load_emode_snapshot"] = "WITH " + ",".join([EVX, CAT]) + f""",
x AS (
  SELECT block_number, raw_log, category_id, ltv, liquidation_threshold, liquidation_bonus, oracle, label
  FROM cat
  UNION ALL
  SELECT block_number, raw_log, CAST((category_id + 1) % 8 AS INTEGER), ltv + 1, liquidation_threshold,
    liquidation_bonus, oracle, label || '+' FROM cat),
f AS (
  SELECT category_id, arg_max(ltv, ok) AS ltv, arg_max(liquidation_threshold, ok) AS liquidation_threshold,
    arg_max(liquidation_bonus, ok) AS liquidation_bonus, arg_max(oracle, ok) AS oracle,
    arg_max(label, ok) AS label, max(ok) AS last_ok
  FROM (SELECT *, {ordk('block_number', 'raw_log')} AS ok FROM x) GROUP BY category_id)
SELECT category_id, ltv, liquidation_threshold, liquidation_bonus, oracle, label,
  {ok_block('last_ok')} AS last_updated_block, {ok_log('last_ok')} AS last_updated_log_index FROM f"""

# ------------------------------------------------------------- snapshots, reports

PAGES = f"""
pg AS (
  SELECT {addr('s_suppkey')} AS user_address, {addr(asset('r'))} AS asset_address, r,
    (s_suppkey * 31 + r * 17) % 1000 * 100 AS supply, (s_suppkey * 13 + r * 29) % 700 * 100 AS debt,
    (s_suppkey + r) % 2 = 0 AS coll,
    CAST({RAY} + CAST(r AS HUGEINT) * {E21} AS VARCHAR) AS idx
  FROM supplier, range(0, 50) t(r))"""

SQL["load_position_snapshot"] = "WITH " + PAGES + """
SELECT user_address, asset_address, CAST(supply AS BIGINT) AS scaled_atoken_balance,
  CAST(debt AS BIGINT) AS scaled_variable_debt, coll AS use_as_collateral, idx AS atoken_last_index,
  idx AS debt_last_index, CAST(5000 AS BIGINT) AS last_updated_block,
  CAST(-1 AS BIGINT) AS last_updated_log_index, true AS is_active, CAST(5000 AS BIGINT) AS created_at_block
FROM pg WHERE supply > 0 OR debt > 0"""

SQL["orphan_check"] = "WITH " + PAGES + """
SELECT user_address || asset_address AS id, 'unknown_reserve' AS reason
FROM pg WHERE (supply > 0 OR debt > 0) AND r >= 45"""

FOLD_SQL = ledger_ctes() + "," + FOLD_UNSEEDED
SEEDED_SQL = ledger_ctes() + "," + SNAPSHOT + "," + FOLD_SEEDED + f""",
sfold AS (SELECT {POSITION_COLS} FROM seeded UNION ALL SELECT {POSITION_COLS} FROM unseeded)"""

SQL["positions_with_tokens"] = FOLD_SQL + """
SELECT f.user_address, f.asset_address, f.scaled_atoken_balance, f.scaled_variable_debt,
  f.last_updated_block, r.atoken_address, r.v_debt_token_address
FROM fold f JOIN res r ON f.asset_address = r.asset_address"""

SQL["above_dust"] = FOLD_SQL + f"""
SELECT {POSITION_COLS} FROM fold WHERE scaled_atoken_balance > 5 OR scaled_variable_debt > 5"""

SQL["changed_after"] = SEEDED_SQL + f"""
SELECT {POSITION_COLS} FROM sfold
WHERE last_updated_block > 7500 AND last_updated_block > created_at_block"""

SQL["snapshot_only"] = SEEDED_SQL + f"""
SELECT {POSITION_COLS} FROM sfold
WHERE created_at_block = last_updated_block AND last_updated_log_index = -1"""

SQL["nonzero_positions"] = SEEDED_SQL + f"""
SELECT {POSITION_COLS} FROM sfold WHERE scaled_atoken_balance > 0 OR scaled_variable_debt > 0"""

SQL["lookup_keys"] = FOLD_SQL + "," + UE + "," + USER_EMODE_FOLD + f"""
SELECT {POSITION_COLS} FROM fold
WHERE user_address IN (SELECT user_address FROM uef WHERE emode_category_id > 0)"""

SQL["lookup_keys_categories"] = "WITH " + ",".join([EVX, CAT, CAT_FOLD, UE, USER_EMODE_FOLD]) + f"""
SELECT category_id, ltv, liquidation_threshold, liquidation_bonus, oracle, label,
  {ok_block('last_ok')} AS last_updated_block, {ok_log('last_ok')} AS last_updated_log_index
FROM catf WHERE category_id IN (SELECT emode_category_id FROM uef WHERE emode_category_id > 0)"""

SQL["lookup_keys_reserve_ids"] = "WITH " + ",".join([EVX, EMA, FLAGS]) + f"""
SELECT {addr('p_partkey')} AS asset_address, CAST(p_partkey AS INTEGER) AS reserve_id, p_name AS symbol
FROM part WHERE p_partkey IN (SELECT reserve_id FROM members WHERE flag)"""

SQL["emode_categories"] = "WITH " + ",".join([EVX, EMA, FLAGS, CAT, CAT_FOLD]) + f""",
bms AS (SELECT category_id, {_bm('collateral')}, {_bm('borrowable')}, {_bm('ltvzero')} FROM members GROUP BY category_id)
SELECT c.category_id, ltv, liquidation_threshold, liquidation_bonus, oracle, label,
  {ok_block('last_ok')} AS last_updated_block, {ok_log('last_ok')} AS last_updated_log_index,
  bms.* EXCLUDE (category_id)
FROM catf c LEFT JOIN bms ON c.category_id = bms.category_id"""

SQL["bitmaps_as_of"] = "WITH " + ",".join([EVX, EMA, CAT]) + f""",
flags AS (
  SELECT p.category_id, p.block_number, bitmap, CAST(r AS INTEGER) AS reserve_id,
    arg_max(flag, {ordk('e.block_number', 'e.raw_log')}) AS flag
  FROM (SELECT DISTINCT category_id, block_number FROM cat) p
  JOIN ema e ON e.category_id = p.category_id AND e.block_number <= p.block_number
  WHERE r < 45 GROUP BY ALL),
bms AS (
  SELECT category_id, block_number, {_bm('collateral')}, {_bm('borrowable')}, {_bm('ltvzero')}
  FROM flags GROUP BY category_id, block_number)
SELECT c.category_id, c.block_number, c.raw_log AS log_index,
  """ + ", ".join(f"coalesce({b}_bitmap, '0x{'0' * 32}') AS {b}_bitmap, coalesce({b}_members, 0) AS {b}_members"
                  for b in ("collateral", "borrowable", "ltvzero")) + """
FROM cat c LEFT JOIN bms b ON c.category_id = b.category_id AND c.block_number = b.block_number"""

SQL["orphan_state"] = f"""
SELECT {addr(asset('p_partkey'))} AS asset_address FROM part WHERE p_partkey % 50 >= 45"""

SQL["oldest_positions"] = FOLD_SQL + f"""
SELECT {POSITION_COLS} FROM fold WHERE scaled_atoken_balance > 5 OR scaled_variable_debt > 5
ORDER BY last_updated_block, user_address, asset_address LIMIT 100"""

SQL["systematic_sample"] = SQL["touched_pairs"].replace(
    "SELECT DISTINCT user_address, asset_address FROM (",
    "SELECT user_address, asset_address FROM (SELECT *, row_number() OVER (ORDER BY user_address, asset_address) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_address, asset_address FROM (",
    1) + """)) WHERE (rn - 1) % greatest(n // 30, 1) = 0 AND rn <= greatest(n // 30, 1) * 29 + 1"""

FAULT_FILTER = "NOT (l_quantity = 49 OR (l_quantity = 50 AND l_returnflag || l_linestatus <> 'AO'))"


def _fold_as(alias: str, fault_filter: str | None) -> str:
    """The unseeded fold with every CTE name prefixed, optionally over the
    fault-filtered lineitem copies."""
    body = ",".join([TOKEN_EVENTS, RESERVES, TOKEN_MAP, RESOLVED, LEGS, FOLD_UNSEEDED])
    if fault_filter:
        body = body.replace("FROM lineitem),", f"FROM lineitem WHERE {fault_filter}),", 1)
    for name in ["li", "dd", "tev", "res", "tmap", "rtev", "legs0", "legs", "hdr", "kl", "rl", "ev", "fold"]:
        import re
        body = re.sub(rf"\b{name}\b(?= AS \()", f"{alias}_{name}", body)
        body = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {alias}_{name}", body)
    return body


REC_SQL = "WITH " + _fold_as("c", FAULT_FILTER) + "," + _fold_as("e", None) + """,
rec AS (
  SELECT coalesce(c.user_address, e.user_address) AS user_address,
    coalesce(c.asset_address, e.asset_address) AS asset_address,
    coalesce(c.scaled_atoken_balance, 0) AS computed_supply, coalesce(c.scaled_variable_debt, 0) AS computed_debt,
    coalesce(e.scaled_atoken_balance, 0) AS expected_supply, coalesce(e.scaled_variable_debt, 0) AS expected_debt
  FROM c_fold c FULL OUTER JOIN e_fold e ON c.user_address = e.user_address AND c.asset_address = e.asset_address),
rec2 AS (
  SELECT *, abs(computed_supply - expected_supply) AS diff_supply, abs(computed_debt - expected_debt) AS diff_debt
  FROM rec)"""

SQL["reconcile"] = REC_SQL + """
SELECT *, diff_supply <= 5 AND diff_debt <= 5 AS within_tolerance FROM rec2"""

SQL["pass_fail_summary"] = REC_SQL + """
SELECT count(*) AS n_pairs,
  CAST(sum(CASE WHEN diff_supply <= 5 AND diff_debt <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_pass,
  CAST(sum(CASE WHEN NOT (diff_supply <= 5 AND diff_debt <= 5) THEN 1 ELSE 0 END) AS BIGINT) AS n_fail,
  CAST(sum(CASE WHEN diff_supply > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_supply_diff,
  CAST(sum(CASE WHEN diff_debt > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_debt_diff
FROM rec2"""


def _contains_any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower(message), '{p}'), false)" for p in patterns) + ")"


def _first(patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(message), '{p}') THEN '{p}'" for p in patterns) + " END"


SQL["classify_error_text"] = f"""
WITH m AS (
  SELECT 'conversations' AS source, CAST(conv_id * 1000 + turn AS BIGINT) AS message_id, text AS message
  FROM conversations
  UNION ALL SELECT 'documents', CAST(doc_id AS BIGINT), text FROM documents)
SELECT source, message_id, {_contains_any(RETRYABLE_PATTERNS)} AS is_retryable,
  {_contains_any(PROVIDER_PATTERNS)} AS is_provider_error,
  {_first(RETRYABLE_PATTERNS)} AS retryable_match, {_first(PROVIDER_PATTERNS)} AS provider_match
FROM m"""

SQL["asof_contract_read"] = "WITH " + EVX + """,
reads AS (
  SELECT CAST(user_id % 10 AS INTEGER) AS entity, block_number, arg_max(k, log_index) AS value
  FROM evx WHERE event_type = 'click' GROUP BY 1, 2),
probes AS (
  SELECT event_id AS probe_id, CAST(user_id % 10 AS INTEGER) AS entity, block_number, log_index
  FROM evx WHERE event_type = 'view')
SELECT p.entity, p.probe_id, p.block_number, p.log_index, r.value
FROM probes p ASOF LEFT JOIN reads r ON p.entity = r.entity AND p.block_number >= r.block_number"""

SQL["diagnose_drift"] = REC_SQL + f""",
fail AS (
  SELECT r.*, c.created_at_block, c.last_updated_block
  FROM rec2 r JOIN c_fold c USING (user_address, asset_address)
  WHERE NOT (r.diff_supply <= 5 AND r.diff_debt <= 5)),
hist AS (
  SELECT ua AS user_address, aa AS asset_address, block_number,
    arg_max(run_s, ok) AS exp_s, arg_max(run_d, ok) AS exp_d
  FROM e_rl GROUP BY ua, aa, block_number),
atc AS (
  SELECT f.*, h.exp_s AS c_s, h.exp_d AS c_d FROM fail f ASOF LEFT JOIN hist h
  ON f.user_address = h.user_address AND f.asset_address = h.asset_address
  AND f.created_at_block >= h.block_number),
atu AS (
  SELECT a.*, h.exp_s AS u_s, h.exp_d AS u_d FROM atc a ASOF LEFT JOIN hist h
  ON a.user_address = h.user_address AND a.asset_address = h.asset_address
  AND a.last_updated_block >= h.block_number),
sides AS (
  SELECT user_address, asset_address, 'supply' AS side, diff_supply AS diff,
    abs(computed_supply - coalesce(c_s, 0)) AS dc, abs(computed_supply - coalesce(u_s, 0)) AS du
  FROM atu WHERE diff_supply > 5
  UNION ALL
  SELECT user_address, asset_address, 'debt', diff_debt,
    abs(computed_debt - coalesce(c_d, 0)), abs(computed_debt - coalesce(u_d, 0))
  FROM atu WHERE diff_debt > 5)
SELECT user_address, asset_address, side, CAST(diff AS HUGEINT) AS diff,
  CAST(dc AS HUGEINT) AS diff_at_created, CAST(du AS HUGEINT) AS diff_at_updated,
  CASE WHEN dc = diff THEN 'at_creation' WHEN du <> diff THEN 'after_creation'
       ELSE 'within_tolerance' END AS origin
FROM sides"""

# Streaming results equal the batch fold / dedup on the same input.
SQL["stream_apply"] = SQL["fold_positions"]
SQL["stateful_positions"] = SQL["fold_positions"]
SQL["stream_dedup"] = SQL["insert_if_absent"]
SQL["stream_once"] = SQL["insert_if_absent"]

SQL["entity_key"] = "WITH " + ",".join([EVX, CFG, EMA, CAT]) + """
SELECT tx_hash, log_index, event, asset AS entity FROM cfg
UNION ALL SELECT tx_hash, log_index, event, asset FROM ema
UNION ALL SELECT tx_hash, log_index, 'EModeCategoryAdded', NULL FROM cat"""

SQL["token_union"] = "WITH " + RESERVES + "," + TOKEN_MAP + """
SELECT token, asset_address, token_type FROM tmap"""

SQL["load_bitmap_as_of"] = "WITH " + ",".join([EVX, EMA, CAT]) + """,
reads AS (
  SELECT category_id, block_number, arg_max(ltv, raw_log) AS ltv, arg_max(label, raw_log) AS label
  FROM cat GROUP BY category_id, block_number)
SELECT e.category_id, e.block_number, e.raw_log AS log_index, e.asset, e.bitmap, e.flag, r.ltv, r.label
FROM ema e ASOF LEFT JOIN reads r ON e.category_id = r.category_id AND e.block_number >= r.block_number"""

SQL["merge_overwrite_state"] = SQL["load_reserve_state_snapshot"].replace(
    "last_updated_block, last_updated_log_index\nFROM snapres",
    "CASE WHEN r % 50 < 45 THEN 0 ELSE last_updated_block END AS last_updated_block,\n"
    "  CASE WHEN r % 50 < 45 THEN -1 ELSE last_updated_log_index END AS last_updated_log_index\nFROM snapres") + f"""
UNION ALL
SELECT {addr('p_partkey')}, '1', '1', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -1 FROM part WHERE p_partkey % 50 >= 45"""

SQL["insert_if_absent_positions"] = FOLD_SQL + "," + PAGES + f""",
snaprows AS (
  SELECT user_address, asset_address, CAST(supply AS BIGINT) AS scaled_atoken_balance,
    CAST(debt AS BIGINT) AS scaled_variable_debt, coll AS use_as_collateral, idx AS atoken_last_index,
    idx AS debt_last_index, CAST(5000 AS BIGINT) AS last_updated_block,
    CAST(-1 AS BIGINT) AS last_updated_log_index, true AS is_active, CAST(5000 AS BIGINT) AS created_at_block
  FROM pg WHERE (supply > 0 OR debt > 0) AND r < 45)
SELECT {POSITION_COLS} FROM fold
UNION ALL
SELECT {POSITION_COLS} FROM snaprows s
WHERE NOT EXISTS (SELECT 1 FROM fold f WHERE f.user_address = s.user_address AND f.asset_address = s.asset_address)"""

SQL["late_guard"] = "WITH " + UE + f""",
st AS (
  SELECT user_address, max({ordk('block_number', 'log_index')}) AS sok
  FROM ue WHERE block_number < 10000 GROUP BY user_address)
SELECT u.user_address, u.block_number, u.log_index, u.category_id
FROM ue u JOIN st s USING (user_address)
WHERE {ordk('u.block_number', 'u.log_index')} <= s.sok"""

SQL["stream_logs"] = "WITH " + ",".join([TOPIC_DIM, RAW_TOKEN]) + """
SELECT r.tx_hash, r.log_index, r.event, t.family
FROM rawtok r JOIN topic_dim t ON r.event = t.event WHERE r.l_quantity <> 49"""

SQL["resume"] = SQL["fold_positions"]

SQL["fold_reserves_healed"] = "WITH " + ",".join([EVX, CFG, RES_FULL, SNAP_RES]) + f""",
firstb AS (SELECT asset, min(block_number) AS fb FROM cfg WHERE r >= 45 GROUP BY asset),
healed AS (
  SELECT {", ".join("n." + c if not c.startswith("last_updated") else
                    ("f.fb AS last_updated_block" if c == "last_updated_block" else
                     "CAST(-1 AS BIGINT) AS last_updated_log_index") for c in RESERVE_COLS)}
  FROM snapres n JOIN firstb f ON n.asset_address = f.asset WHERE n.last_updated_block <= f.fb),
seedall AS (SELECT * FROM resf UNION ALL SELECT * FROM healed),
ce AS (
  SELECT c.*, {ordk('block_number', 'log_index')} AS ok FROM cfg c JOIN seedall s ON c.asset = s.asset_address
  WHERE event IN ('SupplyCapChanged', 'ReserveFrozen', 'ReserveUnfrozen', 'ReservePaused',
                  'CollateralConfigurationChanged')
    AND {ordk('block_number', 'log_index')} > {ordk('s.last_updated_block', 's.last_updated_log_index')}),
agg AS (
  SELECT asset,
    arg_max(amount, ok) FILTER (WHERE event = 'SupplyCapChanged') AS supply_cap,
    arg_max(event = 'ReserveFrozen', ok) FILTER (WHERE event IN ('ReserveFrozen', 'ReserveUnfrozen')) AS is_frozen,
    arg_max(k % 2 = 0, ok) FILTER (WHERE event = 'ReservePaused') AS is_paused,
    arg_max(amount, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS ltv,
    arg_max(amount + 500, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS liquidation_threshold,
    arg_max(k + 10000, ok) FILTER (WHERE event = 'CollateralConfigurationChanged') AS liquidation_bonus,
    max(ok) AS last_ok
  FROM ce GROUP BY asset)
SELECT r.asset_address, r.symbol, r.decimals, r.reserve_id,
  coalesce(a.liquidation_threshold, r.liquidation_threshold) AS liquidation_threshold,
  coalesce(a.liquidation_bonus, r.liquidation_bonus) AS liquidation_bonus,
  coalesce(a.ltv, r.ltv) AS ltv, r.is_active, coalesce(a.is_frozen, r.is_frozen) AS is_frozen,
  coalesce(a.is_paused, r.is_paused) AS is_paused, r.is_borrowing_enabled, r.is_dropped,
  coalesce(a.supply_cap, r.supply_cap) AS supply_cap, r.borrow_cap, r.reserve_factor,
  r.is_collateral_enabled, r.is_stable_borrow_enabled, r.is_flash_loan_enabled, r.debt_ceiling,
  r.liquidation_protocol_fee, r.is_siloed_borrowing, r.unbacked_mint_cap, r.atoken_address,
  r.v_debt_token_address, r.s_debt_token_address, r.interest_rate_strategy_address,
  coalesce({ok_block('a.last_ok')}, r.last_updated_block) AS last_updated_block,
  coalesce({ok_log('a.last_ok')}, r.last_updated_log_index) AS last_updated_log_index
FROM seedall r LEFT JOIN agg a ON r.asset_address = a.asset"""

SQL["word_to_address"] = "WITH " + TOKEN_EVENTS.replace("WHERE rn = 1", "WHERE rn >= 1") + """
SELECT tx_hash, log_index, u AS address1, CASE WHEN kind = 'AF' THEN peer ELSE u END AS address2
FROM tev WHERE kind <> 'AO'
UNION ALL
SELECT tx_hash, log_index, '0x' || lpad(lower(hex(r)), 40, '0'), u FROM tev WHERE kind = 'AO'"""

SQL["word_to_long"] = "WITH " + ",".join([EVX, CFG]) + """
SELECT tx_hash, log_index, amount AS w0, amount + 500 AS w1, k + 10000 AS w2
FROM cfg WHERE event = 'CollateralConfigurationChanged'"""

SQL["created_at"] = FOLD_SQL + "\nSELECT user_address, asset_address, created_at_block FROM fold"

SQL["parse_decimal"] = "WITH " + PAGES + """
SELECT user_address || asset_address AS id, CAST(supply AS BIGINT) AS scaled_atoken_balance,
  CAST(debt AS BIGINT) AS scaled_variable_debt, idx AS atoken_last_index FROM pg"""

SQL["write_state"] = SQL["fold_positions"]


# ------------------------------------------------------------- wide amounts

# On every fifth asset each amount is n * (2^128 + 1): the folds run on n, the
# product is written out in base 10^18.
E18 = "CAST('1000000000000000000' AS HUGEINT)"


def wide_text(n: str) -> str:
    limbs = [(2 ** 128 + 1) // 10 ** (18 * k) % 10 ** 18 for k in range(3)]
    c0, c1, c2 = (f"abs({n}) * CAST('{c}' AS HUGEINT)" for c in limbs)
    l1 = f"({c1} + ({c0}) // {E18})"
    l2 = f"({c2} + {l1} // {E18})"
    return (f"CASE WHEN {n} = 0 THEN '0' ELSE CASE WHEN {n} < 0 THEN '-' ELSE '' END || ltrim(CAST({l2} AS VARCHAR) || "
            f"lpad(CAST({l1} % {E18} AS VARCHAR), 18, '0') || lpad(CAST(({c0}) % {E18} AS VARCHAR), 18, '0'), '0') END")


def amount_text(n: str, wide: str) -> str:
    return f"CASE WHEN {wide} THEN {wide_text(n)} ELSE CAST({n} AS VARCHAR) END"


_PLAIN_INDEX = f"CAST({RAY} + CAST(l_partkey AS HUGEINT) * {E21} AS HUGEINT)"
WIDE_TOKEN_EVENTS = TOKEN_EVENTS.replace(_PLAIN_INDEX, f"CASE WHEN r % 5 = 0 THEN {RAY} ELSE {_PLAIN_INDEX} END")
FAULT = """CASE WHEN r % 5 = 0 AND event = 'Mint' AND log_index = 7 THEN 'zero_index'
              WHEN r % 5 = 0 AND event = 'Burn' AND log_index = 6 THEN 'overflow' END"""
WIDE_RESOLVED = RESOLVED.replace("rtev AS (", "rtev0 AS (") + f""",
rtev AS (SELECT * FROM rtev0 WHERE {FAULT} IS NULL)"""
WIDE_LEDGER = "WITH " + ",".join([WIDE_TOKEN_EVENTS, RESERVES, TOKEN_MAP, WIDE_RESOLVED, LEGS])
WIDE_ASSET = f"asset_address IN (SELECT {addr(asset('x'))} FROM range(0, 50, 5) t(x))"

SQL["decode_wide_amounts"] = f"""
WITH t AS (
  SELECT {txh('l_orderkey')} AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index, l_partkey % 5 = 0 AS wide,
    CASE WHEN l_returnflag || l_linestatus IN ('RF', 'NF') THEN 'Mint'
         WHEN l_returnflag || l_linestatus IN ('RO', 'NO') THEN 'Burn' ELSE 'BalanceTransfer' END AS event,
    CAST(round(l_extendedprice * 100) AS HUGEINT) AS v,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 5 AS HUGEINT) AS inc,
    {_PLAIN_INDEX} AS plain
  FROM lineitem WHERE l_returnflag || l_linestatus <> 'AO')
SELECT tx_hash, log_index, event,
  CASE WHEN wide AND event = 'Burn' AND log_index = 6 THEN '{2 ** 256 - 1}' ELSE {amount_text('v', 'wide')} END AS value,
  CASE WHEN event <> 'BalanceTransfer' THEN {amount_text('inc', 'wide')} END AS balance_increase,
  CASE WHEN wide AND event = 'Mint' AND log_index = 7 THEN '0' WHEN wide THEN CAST({RAY} AS VARCHAR)
       ELSE CAST(plain AS VARCHAR) END AS idx
FROM t"""

SQL["fold_positions_wide"] = WIDE_LEDGER + "," + FOLD_UNSEEDED + f"""
SELECT * REPLACE ({amount_text('scaled_atoken_balance', WIDE_ASSET)} AS scaled_atoken_balance,
                  {amount_text('scaled_variable_debt', WIDE_ASSET)} AS scaled_variable_debt) FROM fold"""

SQL["running_balance_wide"] = WIDE_LEDGER + "," + FOLD_UNSEEDED + f"""
SELECT ua AS user_address, aa AS asset_address, block_number, log_index, leg,
       {amount_text('run_s', WIDE_ASSET.replace('asset_address', 'aa'))} AS running_supply,
       {amount_text('run_d', WIDE_ASSET.replace('asset_address', 'aa'))} AS running_debt FROM rl"""

SQL["ledger_rejects"] = WIDE_LEDGER + f"""
SELECT u AS user_address, asset_address, block_number, log_index, tx_hash, 0 AS leg, {FAULT} AS reason
FROM rtev0 WHERE {FAULT} IS NOT NULL"""


# ------------------------------------------------------------- amounts as text

# Amounts leave the queries as exact decimal text, whatever their size.
_BALANCES = ("scaled_atoken_balance", "scaled_variable_debt")
AMOUNT_TEXT: dict[str, tuple[str, ...]] = {
    **{q: _BALANCES for q in (
        "fold_positions", "position_balances", "fold_positions_seeded", "state_as_of", "states_as_of", "load_position_snapshot",
        "positions_with_tokens", "above_dust", "changed_after", "snapshot_only", "nonzero_positions", "lookup_keys",
        "oldest_positions", "insert_if_absent_positions", "stream_apply", "resume", "write_state", "stateful_positions",
        "parse_decimal")},
    "running_balance": ("running_supply", "running_debt"),
    "position_legs": ("d_supply", "d_debt"),
    "reconcile": ("computed_supply", "computed_debt", "expected_supply", "expected_debt", "diff_supply", "diff_debt"),
    "diagnose_drift": ("diff", "diff_at_created", "diff_at_updated"),
    "ray_div": ("scaled_value",), "mint_delta": ("delta",), "burn_delta": ("delta",),
}
for _q, _cols in AMOUNT_TEXT.items():
    _casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _cols)
    SQL[_q] = f"SELECT * REPLACE ({_casts}) FROM (\n{SQL[_q]}\n)"
