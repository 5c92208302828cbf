"""DuckDB oracle SQL, one statement per query key.

The oracle works on the *plain* driver columns (views region, nation, events, orders, lineitem ...),
applying the adapter layout of vaultlake.sources.ledger arithmetically, while the Spark side builds
the ledger JSON and decodes it.  So the decode path is checked, not mirrored.
"""

from __future__ import annotations

from vaultlake.config import APY_ASSETS, FACTORY_CONTRACT, NATIVE_ASSET_CONTRACT, STRATEGIES, VaultConfig

CFG = VaultConfig()
PEGGED = ", ".join(f"'{c}'" for c in CFG.pegged_codes)


def dec(x: str) -> str:
    """integer units -> DECIMAL(38,7)"""
    return f"CAST(CAST({x} AS DECIMAL(30,0)) * CAST('0.0000001' AS DECIMAL(8,7)) AS DECIMAL(38,7))"


def dec13(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(20,0)) * CAST('0.0000001' AS DECIMAL(8,7)) AS DECIMAL(13,7))"


def asset_of(r: str) -> str:
    return f"(CASE WHEN {r} = 1 THEN '{NATIVE_ASSET_CONTRACT}' ELSE 'CA' || CAST({r} AS VARCHAR) END)"


def vault_of(num: str) -> str:
    return f"('CV' || lpad(CAST({num} AS VARCHAR), 4, '0'))"


STRAT_LIST = "[" + ", ".join(f"'{a}'" for _, a, _ in STRATEGIES) + "]"


def strat_of(k: str) -> str:
    return f"list_extract({STRAT_LIST}, CAST(({k}) % 10 AS INTEGER) + 1)"


STRATEGY_VALUES = ", ".join(f"('{n}', '{a}', '{t}')" for n, a, t in STRATEGIES)
APY_ASSET_LIST = ", ".join(f"'{a}'" for a in APY_ASSETS)

# ---- shared CTEs ---------------------------------------------------------------------------
CTE = {}
CTE["nat"] = f"""nat AS (
  SELECT n_nationkey AS n, n_name, n_regionkey AS r, {vault_of('n_nationkey')} AS vault FROM nation)"""
CTE["vault_info"] = f"""vault_info AS (
  SELECT vault,
    CASE WHEN n % 12 = 11 THEN NULL
         ELSE n_name || '-v3' || ' - ' || substr(vault, 1, 3) || '..' || substr(vault, length(vault) - 2, 3) END AS vault_name,
    upper(substr(n_name, 1, 3)) AS vault_symbol,
    {asset_of('r')} AS asset,
    CASE r WHEN 0 THEN 'USDC' WHEN 1 THEN 'XLM' WHEN 2 THEN 'EURC' WHEN 4 THEN 'AQUA' ELSE 'UNKNOWN' END AS asset_code
  FROM nat)"""
CTE["ve_base"] = """ve_base AS (
  SELECT event_id, ts AS closed_at, date_trunc('hour', ts) AS closed_at_hour,
    'CV' || lpad(CAST((event_id // 2) % 25 AS VARCHAR), 4, '0') AS vault,
    'T' || lpad(CAST(event_id // 2 AS VARCHAR), 10, '0') AS tx_hash,
    event_id // 2 AS tx_id,
    (event_id // 2) % 25 AS vnum,
    CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'deposit' END AS event,
    'G' || CAST(user_id AS VARCHAR) AS acct,
    CAST(round(value * 100) AS BIGINT) * 100000 AS amt_u,
    CAST(round(value * 100) AS BIGINT) * 100000 + CASE WHEN event_id % 5 = 0 THEN 100000 ELSE 0 END AS amt_all_u,
    CASE WHEN ((event_id // 2) % 25) % 7 = 0 THEN 0
         ELSE ((event_id * 7919) % 1000003) * 10000000 + event_id % 997 END AS tvl_u
  FROM events WHERE event_type IN ('purchase', 'error'))"""
CTE["ve_tx"] = """ve_tx AS (
  SELECT vault, tx_hash, max(acct) AS to_addr, sum(amt_all_u) AS tx_amt_u FROM ve_base GROUP BY vault, tx_hash)"""
CTE["vault_events"] = f"""vault_events AS (
  SELECT closed_at, vault, vault_name, asset, asset_code, event, "to", amount, total_amount, closed_at_hour, tx_hash
  FROM (
    SELECT DISTINCT b.vault, vi.vault_name, vi.asset, vi.asset_code, b.closed_at, b.closed_at_hour, b.tx_hash, b.tx_id,
      b.event, {dec('t.tx_amt_u')} AS amount, t.to_addr AS "to", {dec('b.tvl_u')} AS total_amount
    FROM ve_base b JOIN ve_tx t ON t.vault = b.vault AND t.tx_hash = b.tx_hash
    LEFT JOIN vault_info vi ON vi.vault = b.vault
    WHERE b.event_id % 97 <> 0) x)"""
CTE["prices"] = f"""price_days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
prices_raw AS (
  SELECT {asset_of('q.r')} AS contract_id,
    {dec13('10000000 + q.r * 2500000 + dayofmonth(d) * 100000 - q.dup * 50000')} AS price,
    CAST(d AS TIMESTAMP) AS closed_at_day
  FROM price_days, (VALUES (1, 0), (1, 1), (2, 0), (2, 1), (4, 0), (4, 1)) q(r, dup)
  WHERE q.dup = 0 OR dayofmonth(d) % 2 = 0),
prices AS (SELECT contract_id AS token, closed_at_day AS day, max(price) AS price FROM prices_raw GROUP BY 1, 2)"""
PEG_PRICE = f"CASE WHEN e.asset_code IN ({PEGGED}) THEN CAST(1 AS DECIMAL(38,7)) ELSE p.price END"
CTE["tvl_hours"] = f"""hourly AS (
  SELECT vault, vault_name, asset, asset_code, date_trunc('hour', closed_at) AS hour, max(total_amount) AS asset_tvl
  FROM vault_events GROUP BY vault, vault_name, asset, asset_code, date_trunc('hour', closed_at)),
tvl_hours AS (
  SELECT e.hour, e.vault, e.vault_name, e.asset, e.asset_code, e.asset_tvl,
    CAST({PEG_PRICE} AS DECIMAL(38,7)) AS asset_price,
    CAST(e.asset_tvl * ({PEG_PRICE}) AS DECIMAL(38,7)) AS usd_tvl
  FROM hourly e LEFT JOIN prices p ON p.token = e.asset AND date_trunc('day', e.hour) = p.day
  WHERE e.asset_code IN ({PEGGED}) OR p.price IS NOT NULL)"""
CTE["filled"] = """daily AS (
  SELECT date_trunc('day', hour) AS day, vault, vault_name, asset, asset_code,
    max(asset_tvl) AS asset_tvl, max(usd_tvl) AS usd_tvl
  FROM tvl_hours GROUP BY date_trunc('day', hour), vault, vault_name, asset, asset_code),
live_keys AS (SELECT DISTINCT vault, vault_name, asset, asset_code FROM daily WHERE asset_tvl > 0),
all_days AS (
  SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS TIMESTAMP) AS day),
grid AS (
  SELECT d.day, k.vault, k.vault_name, k.asset, k.asset_code, t.asset_tvl, t.usd_tvl
  FROM all_days d CROSS JOIN live_keys k LEFT JOIN daily t ON t.day = d.day AND t.vault = k.vault),
spans AS (
  SELECT vault, day AS since, lead(day) OVER (PARTITION BY vault ORDER BY day) AS until, asset_tvl, usd_tvl,
    row_number() OVER (PARTITION BY vault ORDER BY day) AS nth
  FROM daily WHERE asset_tvl IS NOT NULL),
filled AS (
  SELECT g.day, g.vault, g.vault_name, g.asset, g.asset_code, s.asset_tvl, s.usd_tvl, coalesce(s.nth, 0) AS nth
  FROM grid g LEFT JOIN spans s ON s.vault = g.vault AND g.day >= s.since AND (s.until IS NULL OR g.day < s.until)),
filled_days AS (SELECT * EXCLUDE (nth) FROM filled WHERE asset_tvl IS NOT NULL)"""
CTE["latest"] = """latest AS (
  SELECT day AS latest_day, vault, vault_name, asset, asset_code, asset_tvl, usd_tvl
  FROM filled_days QUALIFY row_number() OVER (PARTITION BY vault ORDER BY day DESC) = 1)"""

DEPS = {
    "nat": [],
    "vault_info": ["nat"],
    "ve_base": [],
    "ve_tx": ["ve_base"],
    "vault_events": ["vault_info", "ve_base", "ve_tx"],
    "prices": [],
    "tvl_hours": ["vault_events", "prices"],
    "filled": ["tvl_hours"],
    "latest": ["filled"],
}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + body


def register_cte(name: str, sql: str, deps: list[str]) -> None:
    CTE[name] = sql
    DEPS[name] = deps


ORACLE: dict[str, str] = {}

ORACLE["vault_registry"] = with_ctes(
    ["nat"], "SELECT CAST('2023-11-30 00:00:00' AS TIMESTAMP) + n * INTERVAL 1 HOUR AS closed_at, vault FROM nat"
)
ORACLE["vault_info"] = with_ctes(["vault_info"], "SELECT * FROM vault_info")
ORACLE["vault_events"] = with_ctes(["vault_events"], "SELECT * FROM vault_events")
ORACLE["tvl_hours"] = with_ctes(["tvl_hours"], "SELECT * FROM tvl_hours")
ORACLE["tvl_days_filled"] = with_ctes(["filled"], "SELECT * FROM filled_days")
ORACLE["latest_vaults"] = with_ctes(["latest"], "SELECT * FROM latest")
ORACLE["latest_usd_tvl"] = with_ctes(["latest"], "SELECT sum(usd_tvl) AS total_usd_tvl FROM latest")
ORACLE["aggregated_stats"] = with_ctes(
    ["vault_events"],
    """SELECT vault, vault_name, count(DISTINCT "to") AS total_accounts, count(DISTINCT tx_hash) AS total_txs,
  (SELECT count(DISTINCT "to") FROM vault_events) AS total_accounts_all,
  (SELECT count(DISTINCT tx_hash) FROM vault_events) AS total_txs_all
FROM vault_events GROUP BY vault, vault_name""",
)

# ---- strategies ------------------------------------------------------------------------------
register_cte("strategies", f"""strategies AS (
  SELECT * FROM (VALUES {STRATEGY_VALUES}) s(strategy_name, strategy_address, asset_token))""", [])
register_cte("apy_set", f"""apy_set AS (
  SELECT strategy_address AS contract_id, asset_token AS asset, strategy_name FROM strategies
  WHERE strategy_name LIKE '%yieldblox_strategy%' AND asset_token IN ({APY_ASSET_LIST}))""", ["strategies"])
register_cte("clicks", f"""clicks AS (
  SELECT event_id, ts AS closed_at, date_trunc('hour', ts) AS closed_at_hour,
    'T' || lpad(CAST(event_id // 2 AS VARCHAR), 10, '0') AS tx_hash,
    {strat_of('event_id')} AS contract_id,
    {dec('CAST(round(value * 100) AS BIGINT) * 100000')} AS ev_amount,
    {dec('10000000 + event_id')} AS ev_pps
  FROM events WHERE event_type = 'click')""", [])
register_cte("harvest_events", """harvest_base AS (
  SELECT c.* FROM clicks c WHERE c.contract_id IN (SELECT contract_id FROM apy_set)),
harvest_tx AS (SELECT tx_hash, max(ev_amount) AS amount, max(ev_pps) AS price_per_share FROM harvest_base GROUP BY tx_hash),
harvest_events AS (
  SELECT b.closed_at_hour AS hour, b.contract_id AS strategy_address, s.asset, t.amount, t.price_per_share,
    b.tx_hash AS hash, b.closed_at
  FROM harvest_base b LEFT JOIN apy_set s ON s.contract_id = b.contract_id LEFT JOIN harvest_tx t ON t.tx_hash = b.tx_hash)""",
    ["clicks", "apy_set"])
ORACLE["harvest_events"] = with_ctes(["harvest_events"], "SELECT * FROM harvest_events")
ORACLE["harvest_fields"] = with_ctes(["harvest_events"], "SELECT * FROM harvest_tx")
ORACLE["strategy_overview"] = with_ctes(["strategies", "clicks"], """SELECT s.strategy_name, s.strategy_address, s.asset_token,
  CAST(count(c.event_id) AS BIGINT) AS harvests, min(c.closed_at) AS first_harvest, max(c.closed_at) AS last_harvest
FROM strategies s LEFT JOIN clicks c ON c.contract_id = s.strategy_address
GROUP BY s.strategy_name, s.strategy_address, s.asset_token""")

register_cte("fee_tuples", f"""fee_tuples AS (
  SELECT {vault_of('(event_id // 2) % 25')} AS vault, ts AS closed_at, date_trunc('hour', ts) AS closed_at_hour,
    'T' || lpad(CAST(event_id // 2 AS VARCHAR), 10, '0') AS tx_hash, event_id // 2 AS tx_id,
    'CA' || CAST(i AS VARCHAR) AS recipient_address,
    {dec('CAST(round(value * 100) AS BIGINT) * 1000 * (i + 1)')} AS fee_amount
  FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS i FROM events WHERE event_type = 'view') x)""", [])
ORACLE["fee_tuples"] = with_ctes(["fee_tuples"], "SELECT * FROM fee_tuples")
ORACLE["fees_distributed"] = with_ctes(["fee_tuples", "vault_info"], """SELECT f.closed_at, f.closed_at_hour, f.vault, v.vault_name,
  v.asset, v.asset_code, f.recipient_address, f.fee_amount, f.tx_hash, f.tx_id
FROM fee_tuples f LEFT JOIN vault_info v ON v.vault = f.vault""")

register_cte("reports", f"""reports AS (
  SELECT {vault_of('l_suppkey % 25')} AS vault, l_shipdate AS closed_at, l_orderkey AS ledger_sequence,
    {strat_of('l_partkey')} AS strategy_address,
    {dec('CAST(round(l_tax * 100) AS BIGINT) * 100000')} AS locked_fee,
    {dec('(CAST(round(l_discount * 100) AS BIGINT) - 5) * 100000')} AS gains_or_losses,
    {dec('CAST(round(l_extendedprice * 100) AS BIGINT) * 100000')} AS prev_balance
  FROM lineitem WHERE l_returnflag <> 'R')""", [])
ORACLE["report_key"] = with_ctes(["reports"], "SELECT vault, closed_at, ledger_sequence, strategy_address FROM reports")
ORACLE["report_pivot"] = with_ctes(["reports"], "SELECT DISTINCT * FROM reports")
ORACLE["locked_fees"] = with_ctes(["reports", "vault_info"], """SELECT r.closed_at, r.ledger_sequence, r.vault, v.vault_name, v.asset,
  v.asset_code, r.strategy_address, r.locked_fee, r.gains_or_losses, r.prev_balance
FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY vault, strategy_address
      ORDER BY closed_at DESC, ledger_sequence DESC, locked_fee DESC, gains_or_losses DESC, prev_balance DESC) = 1) r
LEFT JOIN vault_info v ON v.vault = r.vault""")

HORIZONS = (("24h", "INTERVAL 24 HOUR"), ("7d", "INTERVAL 7 DAY"), ("30d", "INTERVAL 30 DAY"))


def _endpoint_sql() -> str:
    parts = []
    for s, iv in HORIZONS:
        inside = f"h.closed_at >= mt.max_time - {iv}"
        parts += [
            f"min(CASE WHEN {inside} THEN h.closed_at END) AS first_time_{s}",
            f"max(CASE WHEN {inside} THEN h.closed_at END) AS last_time_{s}",
            f"count(CASE WHEN {inside} THEN 1 END) AS events_{s}",
        ]
    vals = []
    for s, _ in HORIZONS:
        vals += [
            f"(SELECT max(h2.pps) FROM h h2 WHERE h2.contract_id = r.contract_id AND h2.closed_at = r.first_time_{s}) AS pps_{s}_start",
            f"(SELECT max(h2.pps) FROM h h2 WHERE h2.contract_id = r.contract_id AND h2.closed_at = r.last_time_{s}) AS pps_{s}_end",
        ]
    return f"""h AS (SELECT strategy_address AS contract_id, closed_at, price_per_share AS pps FROM harvest_events
       WHERE price_per_share IS NOT NULL AND price_per_share > 0),
mt AS (SELECT max(closed_at) AS max_time FROM h),
ranges AS (SELECT s.contract_id, s.asset, {', '.join(parts)}
  FROM apy_set s CROSS JOIN mt LEFT JOIN h ON h.contract_id = s.contract_id GROUP BY s.contract_id, s.asset),
endpoints AS (SELECT r.*, {', '.join(vals)} FROM ranges r)"""


register_cte("endpoints", _endpoint_sql(), ["harvest_events"])


def _apy_sql(s: str) -> str:
    ms = f"((epoch_us(last_time_{s}) - epoch_us(first_time_{s})) / 1000.0)"
    return (
        f"CASE WHEN pps_{s}_start IS NOT NULL AND pps_{s}_end IS NOT NULL AND pps_{s}_start > 0 AND last_time_{s} > first_time_{s} "
        f"THEN round(CAST((power(round(CAST(pps_{s}_end AS DOUBLE) / CAST(pps_{s}_start AS DOUBLE), 7), "
        f"365.2425 * 86400000.0 / {ms}) - 1) * 100 AS DECIMAL(38,2)), 2) END AS apy_{s}"
    )


ORACLE["strategy_apy"] = with_ctes(
    ["endpoints"],
    "SELECT asset, contract_id, "
    + ", ".join(_apy_sql(s) for s, _ in HORIZONS)
    + ", events_24h, events_7d, events_30d, "
    + ", ".join(f"pps_{s}_start, pps_{s}_end, first_time_{s}, last_time_{s}" for s, _ in HORIZONS)
    + " FROM endpoints",
)
ORACLE["trailing_endpoints"] = with_ctes(
    ["endpoints"],
    "SELECT asset, contract_id, " + ", ".join(f"first_time_{s}, last_time_{s}, events_{s}" for s, _ in HORIZONS) + " FROM endpoints",
)
ORACLE["pps_at_endpoints"] = with_ctes(
    ["endpoints"],
    "SELECT asset, contract_id, " + ", ".join(f"pps_{s}_start, pps_{s}_end" for s, _ in HORIZONS) + " FROM endpoints",
)

# ---- activity --------------------------------------------------------------------------------
from vaultlake.sources.encode import topics as _topics  # noqa: E402

_VT = CFG.vault_topic
# signup events: kind number event_id % 18; 0-9 of a vault, 10-14 of the factory, 15-16 of a strategy, 17 of an
# asset contract
_SIGNUP_KINDS = {
    _VT: ["paused", "unpaused", "unwind", "invest", "fee_receiver_changed", "manager_changed", "emergency_manager_changed",
          "rebalance_manager_changed", "swap_exact_in", "swap_exact_out"],
    "YieldFactory": ["create", "new_admin", "new_receiver", "new_fee_rate", "new_wasm_hash"],
    "BlendStrategy": ["deposit", "withdraw"],
}
_SIGNUP = "[" + ", ".join(f"'{_topics(s, k)}'" for s, kinds in _SIGNUP_KINDS.items() for k in kinds) + "]"
register_cte("all_events", f"""all_events AS (
  SELECT event_id, event_type, user_id, value, ts AS closed_at,
    'T' || lpad(CAST(event_id // 2 AS VARCHAR), 10, '0') AS transaction_hash,
    event_id // 2 AS transaction_id,
    event_id % 53 <> 0 AS successful,
    CASE WHEN event_type = 'signup' AND event_id % 18 = 17 THEN {asset_of('((event_id // 2) % 25) % 5')}
         WHEN event_type = 'click' OR event_type = 'signup' AND event_id % 18 >= 15 THEN {strat_of('event_id')}
         WHEN event_type = 'signup' AND event_id % 18 >= 10 THEN '{FACTORY_CONTRACT}'
         ELSE {vault_of('(event_id // 2) % 25')} END AS contract_id,
    CASE WHEN event_type = 'purchase' THEN '{_topics(_VT, 'deposit')}'
         WHEN event_type = 'error' AND event_id % 50 = 1 THEN '{_topics(_VT, 'withdraw', 'deposit')}'
         WHEN event_type = 'error' THEN '{_topics(_VT, 'withdraw')}'
         WHEN event_type = 'view' THEN '{_topics(_VT, 'dfees')}'
         WHEN event_type = 'click' THEN '{_topics('BlendStrategy', 'harvest')}'
         WHEN event_id % 18 = 17 THEN '[{{"symbol":"transfer"}},{{"address":"G' || CAST(user_id AS VARCHAR) || '"}},{{"address":"'
           || {vault_of('(event_id // 2) % 25')} || '"}}]'
         ELSE list_extract({_SIGNUP}, CAST(event_id % 18 AS INTEGER) + 1) END AS topics_decoded,
    ts + to_microseconds(CAST((event_id % 60 + 1) * 1000000 AS BIGINT)) AS ingested_at
  FROM events)""", [])
register_cte("txs", """txs AS (
  SELECT o_orderkey AS id, 'T' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS transaction_hash,
    'G' || CAST(o_custkey AS VARCHAR) AS account,
    CAST(round(o_totalprice * 100) AS BIGINT) AS fee_charged, 2 * CAST(round(o_totalprice * 100) AS BIGINT) AS max_fee,
    CAST(1 + o_orderkey % 5 AS INTEGER) AS operation_count, o_orderstatus <> 'F' AS successful,
    CASE WHEN o_orderstatus <> 'F' THEN 'tx_success' ELSE o_orderpriority END AS result_code_s,
    (o_orderkey % 1000) * 1000 AS instr, (o_custkey % 500) * 10 AS rbytes, (o_orderkey % 300) * 10 AS wbytes,
    o_orderdate AS closed_at
  FROM orders)""", [])


def since(table: str, days: int) -> str:
    return f"CAST(CAST((SELECT max(closed_at) FROM {table}) AS DATE) - {days} AS TIMESTAMP)"


ORACLE["events_per_contract"] = with_ctes(["all_events"], f"""SELECT contract_id, count(*) AS total_events,
  count(DISTINCT transaction_hash) AS unique_transactions, min(closed_at) AS first_event, max(closed_at) AS last_event
FROM all_events WHERE successful AND closed_at >= {since('all_events', 30)} GROUP BY contract_id""")
ORACLE["fees_daily"] = with_ctes(["txs"], f"""SELECT date_trunc('day', closed_at) AS day, count(*) AS num_transactions,
  avg(fee_charged) AS avg_fee, min(fee_charged) AS min_fee, max(fee_charged) AS max_fee, CAST(sum(fee_charged) AS BIGINT) AS total_fees
FROM txs WHERE successful AND closed_at >= {since('txs', 30)} GROUP BY 1""")
ORACLE["top_accounts"] = with_ctes(["txs"], f"""SELECT account, count(*) AS num_transactions,
  CAST(sum(operation_count) AS BIGINT) AS total_operations, CAST(sum(fee_charged) AS BIGINT) AS total_fees_paid,
  min(closed_at) AS first_tx, max(closed_at) AS last_tx
FROM txs WHERE successful AND closed_at >= {since('txs', 7)} GROUP BY account ORDER BY num_transactions DESC, account LIMIT 20""")
ORACLE["failure_share"] = with_ctes(["txs"], f"""SELECT result_code_s, count(*) AS failure_count,
  CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE) AS failure_percentage
FROM txs WHERE NOT successful AND closed_at >= {since('txs', 7)} GROUP BY result_code_s""")
_STATE = """'{"map":[{"key":{"symbol":"status"},"val":{"string":"' || o_orderstatus || '"}}]}'"""
ORACLE["state_changes"] = f"""WITH h AS (
  SELECT 'CU' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS contract_id, o_orderkey AS ledger_sequence, o_orderdate AS closed_at,
    {_STATE} AS cur, lag({_STATE}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev
  FROM orders)
SELECT contract_id, ledger_sequence, closed_at, cur AS current_state, prev AS previous_state,
  CASE WHEN prev IS NULL THEN 'CREATED' WHEN cur <> prev THEN 'MODIFIED' ELSE 'NO_CHANGE' END AS change_type
FROM h WHERE prev IS NULL OR cur <> prev"""
ORACLE["events_transactions"] = with_ctes(["all_events", "txs"], """SELECT e.contract_id, e.closed_at, e.topics_decoded,
  t.account, t.fee_charged, t.operation_count
FROM all_events e JOIN txs t ON t.transaction_hash = e.transaction_hash WHERE e.successful""")
ORACLE["asset_contract_events"] = with_ctes(["all_events", "vault_info"], """SELECT e.contract_id, count(*) AS num_events,
  count(DISTINCT e.transaction_hash) AS num_transactions, min(e.closed_at) AS first_event, max(e.closed_at) AS last_event
FROM all_events e WHERE e.successful AND e.contract_id IN (SELECT vault FROM vault_info WHERE asset_code = 'USDC')
GROUP BY e.contract_id""")
ORACLE["asset_vault_events"] = ORACLE["asset_contract_events"]
ORACLE["asset_code_events"] = with_ctes(["all_events"], f"""SELECT e.contract_id, count(*) AS num_events,
  count(DISTINCT transaction_hash) AS num_transactions, min(closed_at) AS first_event, max(closed_at) AS last_event
FROM all_events e JOIN (SELECT DISTINCT {asset_of('r_regionkey')} AS contract_id FROM region WHERE r_regionkey = 0) c
ON c.contract_id = e.contract_id WHERE e.successful GROUP BY e.contract_id""")
ORACLE["hourly_counts_filled"] = with_ctes(["all_events", "vault_info"], f"""SELECT v.vault AS contract_id, h.hour,
  coalesce(c.events_count, 0) AS events_count
FROM vault_info v
CROSS JOIN (SELECT CAST(unnest(generate_series({since('all_events', 7)},
   date_trunc('hour', (SELECT max(closed_at) FROM all_events)), INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour) h
LEFT JOIN (SELECT contract_id, date_trunc('hour', closed_at) AS hour, count(*) AS events_count FROM all_events
           WHERE closed_at >= {since('all_events', 7)} GROUP BY 1, 2) c ON c.contract_id = v.vault AND c.hour = h.hour""")
ORACLE["moving_avg_rank"] = with_ctes(["all_events"], f"""SELECT closed_at, contract_id, events,
  round(avg(events) OVER (PARTITION BY contract_id ORDER BY closed_at ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS moving_avg_100,
  dense_rank() OVER (PARTITION BY date_trunc('hour', closed_at) ORDER BY events DESC) AS hourly_rank
FROM (SELECT closed_at, contract_id, count(*) AS events FROM all_events
      WHERE successful AND closed_at >= {since('all_events', 7)} GROUP BY 1, 2) g""")
_DEP = "CASE WHEN event = 'deposit' THEN amount ELSE 0 END"
_WD = "CASE WHEN event = 'withdraw' THEN amount ELSE 0 END"
_NET = "CASE WHEN event = 'deposit' THEN amount ELSE -amount END"
ORACLE["user_activity"] = with_ctes(["vault_events"], f"""SELECT "to" AS user, count(*) AS num_transactions,
  sum({_DEP}) AS total_deposited, sum({_WD}) AS total_withdrawn
FROM vault_events GROUP BY "to" ORDER BY total_deposited DESC, user LIMIT 10""")
ORACLE["top_depositors"] = with_ctes(["vault_events"], """SELECT "to" AS user, sum(amount) AS total_volume
FROM vault_events WHERE event = 'deposit' GROUP BY "to" ORDER BY total_volume DESC, user LIMIT 10""")
ORACLE["net_flow_vault"] = with_ctes(["vault_events"], f"""SELECT date_trunc('day', closed_at) AS day, vault_name,
  sum({_DEP}) AS deposits, sum({_WD}) AS withdrawals, sum({_NET}) AS net_flow
FROM vault_events GROUP BY 1, 2""")
ORACLE["net_flow"] = with_ctes(["vault_events"], f"""SELECT date_trunc('day', closed_at) AS day, sum({_NET}) AS net_flow
FROM vault_events GROUP BY 1""")
ORACLE["active_users"] = with_ctes(["vault_events"], """SELECT "to" AS user, count(*) AS events, count(DISTINCT tx_hash) AS transactions
FROM vault_events GROUP BY "to" ORDER BY events DESC, user LIMIT 10""")
ORACLE["cohort_retention"] = with_ctes(["vault_events"], """SELECT cohort_week, CAST(date_diff('day', cohort_week, week) / 7 AS INTEGER) AS week_offset,
  count(DISTINCT "user") AS users
FROM (SELECT "to" AS "user", date_trunc('week', closed_at) AS week,
             min(date_trunc('week', closed_at)) OVER (PARTITION BY "to") AS cohort_week FROM vault_events) x
GROUP BY 1, 2""")
ORACLE["busiest_days"] = with_ctes(["vault_events"], """SELECT date_trunc('day', closed_at) AS day, count(*) AS events
FROM vault_events GROUP BY 1 ORDER BY events DESC, day DESC LIMIT 5""")
ORACLE["activity_profile"] = with_ctes(["vault_events"], """SELECT CAST(isodow(closed_at) AS INTEGER) AS iso_weekday,
  CAST(hour(closed_at) AS INTEGER) AS hour_of_day, count(*) AS events, sum(amount) AS volume
FROM vault_events GROUP BY 1, 2""")
ORACLE["vault_transitions"] = with_ctes(["vault_events"], """SELECT vault AS from_vault, next_vault AS to_vault, count(*) AS moves,
  count(DISTINCT "user") AS users
FROM (SELECT *, lead(vault) OVER (PARTITION BY "user" ORDER BY closed_at, tx_hash, vault) AS next_vault
      FROM (SELECT DISTINCT "to" AS "user", closed_at, tx_hash, vault FROM vault_events) d) x
WHERE next_vault IS NOT NULL AND next_vault <> vault GROUP BY 1, 2""")
ORACLE["multi_vault_users"] = with_ctes(["vault_events"], """SELECT "to" AS user, count(DISTINCT vault) AS vaults
FROM vault_events GROUP BY "to" HAVING count(DISTINCT vault) > 1""")
ORACLE["new_vaults"] = with_ctes(["vault_events"], """SELECT vault, vault_name, min(closed_at) AS first_event, count(*) AS events
FROM vault_events GROUP BY vault, vault_name""")
ORACLE["resource_usage"] = with_ctes(["txs"], """SELECT account, count(*) AS transactions, CAST(sum(instr) AS BIGINT) AS instructions,
  CAST(sum(rbytes) AS BIGINT) AS read_bytes, CAST(sum(wbytes) AS BIGINT) AS write_bytes, max(instr) AS max_instructions
FROM txs GROUP BY account""")
ORACLE["fee_headroom"] = with_ctes(["txs"], """SELECT date_trunc('day', closed_at) AS day, CAST(sum(fee_charged) AS BIGINT) AS fee_charged,
  CAST(sum(max_fee) AS BIGINT) AS max_fee, round(CAST(sum(fee_charged) AS DOUBLE) / CAST(sum(max_fee) AS DOUBLE), 6) AS charged_ratio,
  count(CASE WHEN fee_charged >= max_fee THEN 1 END) AS at_limit
FROM txs GROUP BY 1""")
ORACLE["ingest_lag"] = with_ctes(["all_events"], """SELECT date_trunc('day', closed_at) AS day, count(*) AS events,
  min((epoch_us(ingested_at) - epoch_us(closed_at)) / 1e6) AS min_lag_s, max((epoch_us(ingested_at) - epoch_us(closed_at)) / 1e6) AS max_lag_s,
  round(avg((epoch_us(ingested_at) - epoch_us(closed_at)) / 1e6), 6) AS avg_lag_s
FROM all_events GROUP BY 1""")
ORACLE["ingest_lag_quantiles"] = with_ctes(["all_events"], """SELECT contract_id, count(*) AS rows, round(quantile_cont(lag, 0.5), 6) AS p50,
  round(quantile_cont(lag, 0.95), 6) AS p95, round(quantile_cont(lag, 0.99), 6) AS p99
FROM (SELECT contract_id, CAST(epoch_us(ingested_at) - epoch_us(closed_at) AS DOUBLE) AS lag FROM all_events) x GROUP BY contract_id""")
ORACLE["resource_quantiles"] = with_ctes(["all_events", "txs"], """SELECT contract_id, count(*) AS rows, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99
FROM (SELECT DISTINCT contract_id, e.transaction_hash, CAST(instr AS DOUBLE) AS v FROM all_events e JOIN txs t ON e.transaction_hash = t.transaction_hash) x
GROUP BY contract_id""")
ORACLE["topic_frequency"] = with_ctes(["all_events"], """SELECT contract_id, topics_decoded, count(*) AS events,
  count(DISTINCT transaction_hash) AS transactions
FROM all_events GROUP BY 1, 2""")

# ---- tvl analyses -----------------------------------------------------------------------------
register_cte("fprev", """fprev AS (
  SELECT *, lag(usd_tvl) OVER (PARTITION BY vault ORDER BY day) AS prev_tvl FROM filled_days),
newest AS (SELECT max(day) AS d FROM filled_days)""", ["filled"])


def pct(new: str, old: str) -> str:
    return f"round((CAST({new} AS DOUBLE) - CAST({old} AS DOUBLE)) / nullif(CAST({old} AS DOUBLE), 0.0) * 100, 6)"


ORACLE["tvl_change"] = with_ctes(["fprev"], f"""SELECT vault, vault_name, day, usd_tvl, prev_tvl, {pct('usd_tvl', 'prev_tvl')} AS tvl_change_pct
FROM fprev WHERE day = (SELECT d FROM newest)""")


def growth(days: int) -> str:
    return f"""SELECT t.vault, t.usd_tvl AS tvl_today, b.usd_tvl AS tvl_before, {pct('t.usd_tvl', 'b.usd_tvl')} AS growth_pct
FROM filled_days t JOIN filled_days b ON b.vault = t.vault AND b.day = t.day - INTERVAL {days} DAY
WHERE t.day = (SELECT d FROM newest)"""


ORACLE["tvl_growth_30d"] = with_ctes(["fprev"], growth(30))
ORACLE["fastest_growing"] = with_ctes(["fprev"], growth(7) + " ORDER BY growth_pct DESC NULLS LAST, t.vault LIMIT 5")
ORACLE["tvl_by_asset"] = with_ctes(["fprev", "vault_info"], """SELECT m.asset_code, count(DISTINCT m.vault) AS num_vaults, sum(t.usd_tvl) AS total_tvl
FROM vault_info m JOIN filled_days t ON t.vault = m.vault WHERE t.day = (SELECT d FROM newest) GROUP BY m.asset_code""")
ORACLE["asset_share"] = with_ctes(["fprev"], """SELECT asset_code, total_tvl,
  round(CAST(total_tvl AS DOUBLE) / CAST(sum(total_tvl) OVER () AS DOUBLE) * 100, 6) AS share_pct
FROM (SELECT asset_code, sum(usd_tvl) AS total_tvl FROM filled_days WHERE day = (SELECT d FROM newest) GROUP BY asset_code) g""")
register_cte("agg_stats", """agg_stats AS (
  SELECT vault, count(DISTINCT "to") AS total_accounts, count(DISTINCT tx_hash) AS total_txs FROM vault_events GROUP BY vault)""",
    ["vault_events"])
ORACLE["cross_vault"] = with_ctes(["fprev", "vault_info", "agg_stats"], """SELECT v.vault, v.vault_name, v.asset_code, t.usd_tvl, s.total_accounts,
  round(CAST(t.usd_tvl AS DOUBLE) / CAST(nullif(s.total_accounts, 0) AS DOUBLE), 6) AS tvl_per_user,
  round(CAST(s.total_txs AS DOUBLE) / CAST(nullif(s.total_accounts, 0) AS DOUBLE), 6) AS txs_per_user
FROM vault_info v JOIN filled_days t ON t.vault = v.vault AND t.day = (SELECT d FROM newest) JOIN agg_stats s ON s.vault = v.vault""")
ORACLE["vault_assets"] = with_ctes(["ve_base", "prices"], f"""SELECT x.day, x.vault, x.asset, x.asset_code, x.asset_tvl,
  CAST(x.asset_tvl * (CASE WHEN x.asset_code IN ({PEGGED}) THEN CAST(1 AS DECIMAL(38,7)) ELSE p.price END) AS DECIMAL(38,7)) AS usd_tvl
FROM (
  SELECT day, vault, asset, max(tvl) AS asset_tvl,
    CASE asset WHEN 'CA0' THEN 'USDC' WHEN '{NATIVE_ASSET_CONTRACT}' THEN 'XLM' WHEN 'CA2' THEN 'EURC' WHEN 'CA4' THEN 'AQUA' ELSE 'UNKNOWN' END AS asset_code
  FROM (
    SELECT date_trunc('day', closed_at) AS day, vault, {asset_of('vnum % 5')} AS asset, {dec('tvl_u')} AS tvl FROM ve_base WHERE event_id % 97 <> 0
    UNION ALL
    SELECT date_trunc('day', closed_at), vault, 'CA9', {dec('event_id * 1000')} FROM ve_base WHERE event_id % 97 <> 0 AND event_id % 11 = 0
  ) e GROUP BY day, vault, asset) x
LEFT JOIN prices p ON p.token = x.asset AND p.day = x.day
WHERE x.asset_code IN ({PEGGED}) OR p.price IS NOT NULL""")
ORACLE["tvl_volatility"] = with_ctes(["fprev"], """SELECT vault, round(stddev_samp(CAST(usd_tvl AS DOUBLE) - CAST(prev_tvl AS DOUBLE)), 6) AS stddev_daily_change,
  count(CAST(usd_tvl AS DOUBLE) - CAST(prev_tvl AS DOUBLE)) AS changes FROM fprev GROUP BY vault""")
ORACLE["tvl_drops"] = with_ctes(["fprev"], f"""SELECT * FROM (SELECT day, vault, prev_tvl, usd_tvl, {pct('usd_tvl', 'prev_tvl')} AS change_pct FROM fprev) x
WHERE change_pct <= -20.0""")
ORACLE["tvl_trend"] = with_ctes(["fprev"], """SELECT vault,
  round(regr_slope(CAST(usd_tvl AS DOUBLE), CAST(date_diff('day', (SELECT CAST(d AS DATE) FROM newest), CAST(day AS DATE)) AS DOUBLE)), 6) AS slope_per_day,
  round(regr_intercept(CAST(usd_tvl AS DOUBLE), CAST(date_diff('day', (SELECT CAST(d AS DATE) FROM newest), CAST(day AS DATE)) AS DOUBLE)), 4) AS fitted_today,
  count(*) AS days FROM filled_days GROUP BY vault""")
_X = "CAST(date_diff('day', (SELECT CAST(d AS DATE) FROM newest), CAST(day AS DATE)) AS DOUBLE)"
_Y = "CAST(usd_tvl AS DOUBLE)"
ORACLE["tvl_forecast"] = with_ctes(["fprev"], f"""SELECT vault, (SELECT CAST(d AS TIMESTAMP) FROM newest) + k * INTERVAL 1 DAY AS day,
  round(y, 2) AS forecast, round(y - 1.96 * err, 2) AS low, round(y + 1.96 * err, 2) AS high
FROM (SELECT vault, k, icept + slope * k AS y,
        sqrt((syy - slope * slope * sxx) / CASE WHEN n > 2 THEN n - 2 END * (1 + 1.0 / n + (k - mx) * (k - mx) / sxx)) AS err
      FROM (SELECT vault, count(*) AS n, regr_slope({_Y}, {_X}) AS slope, regr_intercept({_Y}, {_X}) AS icept, regr_avgx({_Y}, {_X}) AS mx,
              regr_sxx({_Y}, {_X}) AS sxx, regr_syy({_Y}, {_X}) AS syy FROM filled_days GROUP BY vault) s, range(1, 8) r(k)) f""")
ORACLE["user_growth"] = with_ctes(["vault_events"], """SELECT d.day, active_users, new_users, total_users,
  CASE WHEN total_users > new_users THEN round(CAST(new_users AS DOUBLE) / CAST(total_users - new_users AS DOUBLE) * 100, 6) END AS growth_pct
FROM (SELECT day, count(DISTINCT u.usr) AS active_users, count(DISTINCT CASE WHEN u.day = s.since THEN u.usr END) AS new_users,
        (SELECT count(*) FROM (SELECT "to", min(date_trunc('day', closed_at)) AS since FROM vault_events GROUP BY "to") a
         WHERE a."to" IS NOT NULL AND a.since <= u.day) AS total_users
      FROM (SELECT "to" AS usr, date_trunc('day', closed_at) AS day FROM vault_events WHERE "to" IS NOT NULL) u
      JOIN (SELECT "to" AS usr, min(date_trunc('day', closed_at)) AS since FROM vault_events GROUP BY "to") s ON s.usr = u.usr
      GROUP BY day) d""")
ORACLE["refresh_days"] = ORACLE["tvl_days_filled"]
ORACLE["protocol_tvl"] = with_ctes(["filled"], "SELECT day, sum(usd_tvl) AS total_usd_tvl, count(*) AS vaults FROM filled_days GROUP BY day")
ORACLE["market_share"] = with_ctes(["filled"], """SELECT day, asset_code, tvl,
  round(CAST(tvl AS DOUBLE) / CAST(sum(tvl) OVER (PARTITION BY day) AS DOUBLE) * 100, 6) AS share_pct
FROM (SELECT day, asset_code, sum(usd_tvl) AS tvl FROM filled_days GROUP BY day, asset_code) g""")
ORACLE["price_tvl_corr"] = with_ctes(["tvl_hours"], f"""SELECT asset_code, round(corr(CAST(asset_price AS DOUBLE), CAST(asset_tvl AS DOUBLE)), 6) AS corr,
  count(*) AS hours FROM tvl_hours WHERE asset_code NOT IN ({PEGGED}) GROUP BY asset_code""")
ORACLE["large_withdrawals"] = with_ctes(["vault_events"], """SELECT closed_at, vault, "to", amount, total_amount, tx_hash,
  round(CAST(amount AS DOUBLE) / CAST(total_amount AS DOUBLE), 6) AS share
FROM vault_events WHERE event = 'withdraw' AND total_amount > 0 AND CAST(amount AS DOUBLE) / CAST(total_amount AS DOUBLE) >= 0.001""")
ORACLE["vault_ranking"] = with_ctes(["fprev", "agg_stats"], """SELECT *, round((tvl_rank + accounts_rank + txs_rank) / 3.0, 6) AS mean_rank FROM (
  SELECT t.vault, t.usd_tvl, s.total_accounts, s.total_txs,
    rank() OVER (ORDER BY t.usd_tvl DESC) AS tvl_rank, rank() OVER (ORDER BY s.total_accounts DESC) AS accounts_rank,
    rank() OVER (ORDER BY s.total_txs DESC) AS txs_rank
  FROM filled_days t JOIN agg_stats s ON s.vault = t.vault WHERE t.day = (SELECT d FROM newest)) r""")
ORACLE["vault_outliers"] = with_ctes(["fprev"], """SELECT vault, round((x - avg(x) OVER ()) / nullif(stddev_samp(x) OVER (), 0.0), 6) AS z_score
FROM (SELECT vault, CAST(usd_tvl AS DOUBLE) AS x FROM filled_days WHERE day = (SELECT d FROM newest)) l""")

# ---- typed events and audits -------------------------------------------------------------------
_KINDS = "[" + ", ".join(f"'{k}'" for kinds in _SIGNUP_KINDS.values() for k in kinds) + "]"


def user_of(i: int) -> str:
    return f"('G' || CAST(user_id + {i} AS VARCHAR))"


_LEAST_U = "(CASE WHEN event_id % 5 = 0 THEN least(amt_u, 100000) ELSE amt_u END)"
_SHARES_U = (f"(CASE WHEN tvl_u = 0 THEN CASE WHEN event_type = 'purchase' THEN {_LEAST_U} - 1000 ELSE amt_u END ELSE amt_u * (1 + vnum % 3) END + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END)")
register_cte("ev_units", """ev_units AS (
  SELECT e.*, (event_id // 2) % 25 AS vnum, CAST(round(value * 100) AS BIGINT) * 100000 AS amt_u,
    CASE WHEN ((event_id // 2) % 25) % 7 = 0 THEN 0 ELSE ((event_id * 7919) % 1000003) * 10000000 + event_id % 997 END AS tvl_u
  FROM all_events e)""", ["all_events"])
ORACLE["decode_events"] = with_ctes(["ev_units"], f"""SELECT transaction_hash AS tx_hash, contract_id, closed_at,
  CASE event_type WHEN 'purchase' THEN 'deposit' WHEN 'error' THEN 'withdraw' WHEN 'view' THEN 'dfees' WHEN 'click' THEN 'harvest'
       ELSE list_extract({_KINDS}, CAST(event_id % 18 AS INTEGER) + 1) END AS kind,
  CASE WHEN event_type = 'view' OR event_type = 'signup' AND event_id % 18 NOT IN (0, 1, 4, 15, 16) THEN NULL ELSE {user_of(0)} END AS account,
  CASE WHEN event_type = 'signup' AND event_id % 18 IN (0, 1) THEN {strat_of('event_id')} END AS strategy,
  CASE WHEN event_type IN ('purchase', 'error', 'click') OR event_type = 'signup' AND event_id % 18 IN (15, 16) THEN {dec('amt_u')} END AS amount,
  CASE WHEN event_type IN ('purchase', 'error') THEN CAST({dec('amt_u')} AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN ',0.0100000' ELSE '' END END AS amounts,
  CASE WHEN event_type IN ('purchase', 'error') THEN {dec(_SHARES_U)} END AS shares,
  CASE WHEN event_type <> 'signup' THEN NULL
       WHEN event_id % 18 IN (4, 5, 6, 7, 11, 12) THEN {user_of(1)}
       WHEN event_id % 18 = 10 THEN CAST(event_id % 1000 AS VARCHAR)
       WHEN event_id % 18 = 13 THEN CAST(event_id % 10000 AS VARCHAR)
       WHEN event_id % 18 = 14 THEN md5(CAST(event_id AS VARCHAR)) END AS detail
FROM ev_units WHERE NOT (event_type = 'signup' AND event_id % 18 = 17)""")


def _apy_expr(start: str, end: str, t0: str, t1: str) -> str:
    ms = f"((epoch_us({t1}) - epoch_us({t0})) / 1000.0)"
    return (
        f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL AND {start} > 0 AND {t1} > {t0} "
        f"THEN round(CAST((power(round(CAST({end} AS DOUBLE) / CAST({start} AS DOUBLE), 7), 365.2425 * 86400000.0 / {ms}) - 1) * 100 AS DECIMAL(38,2)), 2) END"
    )


ORACLE["harvest_step_apy"] = with_ctes(["harvest_events"], f"""SELECT strategy_address, closed_at, hash, price_per_share, prev_price_per_share,
  {_apy_expr('prev_price_per_share', 'price_per_share', 'prev_closed_at', 'closed_at')} AS step_apy
FROM (SELECT strategy_address, closed_at, hash, price_per_share,
        lag(price_per_share) OVER (PARTITION BY strategy_address ORDER BY closed_at, hash) AS prev_price_per_share,
        lag(closed_at) OVER (PARTITION BY strategy_address ORDER BY closed_at, hash) AS prev_closed_at
      FROM harvest_events) x""")
ORACLE["fee_audit"] = with_ctes(["fee_tuples"], """SELECT recipient_address, sum(fee_amount) AS total_fees, count(*) AS tuples
FROM fee_tuples GROUP BY ROLLUP (recipient_address)""")
ORACLE["rebalance_log"] = with_ctes(["ev_units"], f"""SELECT list_extract({_KINDS}, CAST(event_id % 18 AS INTEGER) + 1) AS kind,
  contract_id AS vault, closed_at, transaction_hash AS tx_hash, CASE WHEN NOT swap THEN {strat_of('event_id')} END AS strategy,
  {dec('amt_u')} AS amount, CASE WHEN NOT swap THEN {dec('amt_u')} END AS gains_or_losses,
  CASE WHEN NOT swap THEN {dec('0')} END AS locked_fee, CASE WHEN NOT swap THEN {dec('tvl_u')} END AS prev_balance,
  CASE WHEN swap THEN {asset_of('vnum % 5')} END AS asset_in, CASE WHEN swap THEN 'CA9' END AS asset_out,
  CASE event_id % 18 WHEN 8 THEN {dec('amt_u')} WHEN 9 THEN {dec('amt_u + event_id')} END AS amount_in,
  CASE event_id % 18 WHEN 9 THEN {dec('amt_u')} WHEN 8 THEN {dec('amt_u + event_id')} END AS amount_out,
  CASE WHEN swap AND event_id % 2 = 0 THEN {asset_of('vnum % 5')} || ',CA8,CA9' END AS path,
  CASE WHEN swap THEN CAST(1700000000 + event_id AS BIGINT) END AS deadline
FROM (SELECT *, event_id % 18 IN (8, 9) AS swap FROM ev_units) x WHERE event_type = 'signup' AND event_id % 18 IN (2, 3, 8, 9)""")
ORACLE["vault_creations"] = with_ctes(["ev_units"], f"""SELECT transaction_hash AS tx_hash, closed_at, CAST(event_id % 1000 AS BIGINT) AS vault_fee,
  {user_of(0)} AS emergency_manager, {user_of(1)} AS fee_receiver, {user_of(2)} AS manager,
  CASE WHEN event_id % 2 = 0 THEN {user_of(3)} END AS rebalance_manager,
  '0:' || {user_of(0)} || ',1:' || {user_of(1)} || ',2:' || {user_of(2)} || CASE WHEN event_id % 2 = 0 THEN ',3:' || {user_of(3)} ELSE '' END AS roles,
  CASE WHEN second THEN 'CA9' ELSE {asset_of('vnum % 5')} END AS asset,
  CASE WHEN second THEN '' ELSE {strat_of('event_id')} END AS strategies,
  CAST(CASE WHEN NOT second AND event_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS paused_strategies
FROM (SELECT e.*, s.second FROM ev_units e, (VALUES (false), (true)) s(second)) x
WHERE event_type = 'signup' AND event_id % 18 = 10 AND (NOT second OR event_id % 3 = 0)""")
register_cte("flow_units", """flow_units AS (
  SELECT * FROM ev_units WHERE event_type IN ('purchase', 'error'))""", ["ev_units"])
ORACLE["share_price"] = with_ctes(["flow_units"], f"""SELECT transaction_hash AS tx_hash, contract_id AS vault, closed_at,
  CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'deposit' END AS event,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE round(CAST({dec('tvl_u')} AS DOUBLE) / CAST({dec('tvl_u * (1 + vnum % 3)')} AS DOUBLE), 9) END AS share_price
FROM flow_units WHERE tvl_u * (1 + vnum % 3) > 0""")
_H = lambda x: f"CAST({x} AS HUGEINT)"
_MINTED_U = f"(CASE WHEN tvl_u = 0 THEN {_LEAST_U} - 1000 ELSE {_H('amt_u')} * tvl_u * (1 + vnum % 3) // tvl_u END)"
_PAID_U = f"(CASE WHEN tvl_u = 0 THEN 0 ELSE {_H('tvl_u')} * {_SHARES_U} // (tvl_u * (1 + vnum % 3)) END)"
ORACLE["share_reconcile"] = with_ctes(["flow_units"], f"""SELECT transaction_hash AS tx_hash, contract_id AS vault, closed_at,
  CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'deposit' END AS event, {dec('amt_u')} AS amount, {dec(_SHARES_U)} AS shares,
  CASE WHEN event_type = 'purchase' THEN {dec(_MINTED_U)} END AS expected_shares,
  CASE WHEN event_type = 'error' THEN {dec(_PAID_U)} END AS expected_amount
FROM flow_units WHERE event_id % 97 <> 0
  AND CASE WHEN event_type = 'purchase' THEN {_SHARES_U} <> {_MINTED_U} ELSE amt_u <> {_PAID_U} END""")
register_cte("latest_reports", """latest_reports AS (
  SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY vault, strategy_address
      ORDER BY closed_at DESC, ledger_sequence DESC, locked_fee DESC, gains_or_losses DESC, prev_balance DESC) = 1)""", ["reports"])
ORACLE["fee_split"] = with_ctes(["latest_reports"], f"""SELECT vault, strategy_address, locked_fee,
  {dec('CAST(locked_fee * 10000000 AS BIGINT) - (CAST(locked_fee * 10000000 AS BIGINT) * 500) // 1500')} AS vault_share,
  {dec('(CAST(locked_fee * 10000000 AS BIGINT) * 500) // 1500')} AS protocol_share
FROM latest_reports""")
ORACLE["report_deltas"] = with_ctes(["reports"], """SELECT vault, strategy_address, closed_at, ledger_sequence, prev_balance,
  last_prev_balance AS previous_report_balance, CAST(prev_balance - last_prev_balance AS DECIMAL(38,7)) AS delta
FROM (SELECT *, lag(prev_balance) OVER (PARTITION BY vault, strategy_address
        ORDER BY closed_at, ledger_sequence, locked_fee, gains_or_losses, prev_balance) AS last_prev_balance
      FROM (SELECT DISTINCT * FROM reports) d) x""")
ORACLE["allocations"] = with_ctes(["flow_units"], f"""SELECT transaction_hash AS tx_hash, contract_id AS vault, closed_at,
  {asset_of('vnum % 5')} AS asset, {dec('tvl_u // 4')} AS idle_amount, {dec('tvl_u - tvl_u // 4')} AS invested_amount,
  {dec('tvl_u')} AS total_amount, {strat_of('vnum')} AS strategy_address, {dec('tvl_u - tvl_u // 4')} AS allocated, false AS paused
FROM flow_units WHERE event_id % 97 <> 0
UNION ALL
SELECT transaction_hash, contract_id, closed_at, 'CA9', {dec('event_id * 1000')}, {dec('0')}, {dec('event_id * 1000')}, NULL, NULL, NULL
FROM flow_units WHERE event_id % 97 <> 0 AND event_id % 11 = 0""")
ORACLE["strategy_status"] = with_ctes(["ev_units"], f"""SELECT vault, strategy_address, changed_at,
  CASE WHEN kind = 'paused' THEN 'paused' ELSE 'active' END AS status
FROM (SELECT contract_id AS vault, {strat_of('event_id')} AS strategy_address, closed_at AS changed_at,
        CASE WHEN event_id % 18 = 0 THEN 'paused' ELSE 'unpaused' END AS kind, transaction_hash
      FROM ev_units WHERE event_type = 'signup' AND event_id % 18 IN (0, 1)
      QUALIFY row_number() OVER (PARTITION BY contract_id, {strat_of('event_id')} ORDER BY closed_at DESC, transaction_hash DESC) = 1) x""")

ORACLE["allocation_status"] = with_ctes(["flow_units"], f"""SELECT a.transaction_hash AS tx_hash, a.contract_id AS vault, a.closed_at,
  {strat_of('a.vnum')} AS strategy_address, {dec('a.tvl_u - a.tvl_u // 4')} AS allocated, false AS flag, p.closed_at AS changed_at,
  CASE WHEN p.event_id % 18 = 0 THEN 'paused' ELSE 'active' END AS status
FROM flow_units a LEFT JOIN (
  SELECT contract_id, {strat_of('event_id')} AS strategy, closed_at, event_id FROM ev_units WHERE event_type = 'signup' AND event_id % 18 IN (0, 1)) p
ON p.contract_id = a.contract_id AND p.strategy = {strat_of('a.vnum')} AND p.closed_at <= a.closed_at
WHERE a.event_id % 97 <> 0
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY p.closed_at DESC NULLS LAST, p.event_id DESC) = 1""")

# ---- building blocks ------------------------------------------------------------------------
ORACLE["scan_state"] = with_ctes(["nat"], """SELECT vault AS contract_id,
  CAST('2023-12-01 00:00:00' AS TIMESTAMP) + v * INTERVAL 1 DAY + n * INTERVAL 1 MINUTE AS closed_at, CAST(v * 1000 + n AS BIGINT) AS ledger_sequence
FROM nat, (VALUES (1), (2), (3)) t(v)""")
ORACLE["scan_events"] = with_ctes(["all_events"], """SELECT contract_id, closed_at, transaction_hash FROM all_events
WHERE event_type IN ('purchase', 'error')""")
ORACLE["scan_transactions"] = with_ctes(["txs"], f"""SELECT id, account, fee_charged, closed_at FROM txs
WHERE successful AND closed_at >= {since('txs', 30)}""")
ORACLE["decode_i128"] = with_ctes(["flow_units"], f"""SELECT transaction_hash AS tx_hash, contract_id AS vault, closed_at,
  {dec('amt_u')} AS amount, {dec(_SHARES_U)} AS shares, {dec('tvl_u * (1 + vnum % 3)')} AS supply,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE {dec('tvl_u')} END AS funds
FROM flow_units""")
ORACLE["payload_fields"] = with_ctes(["all_events"], """SELECT transaction_hash, closed_at, unnest(CASE WHEN event_type = 'purchase'
  THEN ['amounts', 'depositor', 'df_tokens_minted', 'total_managed_funds_before', 'total_supply_before']
  ELSE ['amounts_withdrawn', 'df_tokens_burned', 'total_managed_funds_before', 'total_supply_before', 'withdrawer'] END) AS symbol
FROM all_events WHERE event_type IN ('purchase', 'error')""")
ORACLE["latest_snapshot"] = with_ctes(["nat"], """SELECT vault,
  CAST('2023-12-01 00:00:00' AS TIMESTAMP) + 3 * INTERVAL 1 DAY + n * INTERVAL 1 MINUTE AS closed_at, CAST(3000 + n AS BIGINT) AS ledger_sequence
FROM nat""")
ORACLE["latest_snapshot_ties"] = with_ctes(["nat"], f"""SELECT DISTINCT {asset_of('r')} AS contract_id,
  CASE r WHEN 0 THEN 'USDC' WHEN 1 THEN 'XLM' WHEN 2 THEN 'EURC' WHEN 4 THEN 'AQUA' ELSE '' END AS asset_code FROM nat""")
ORACLE["contract_metadata"] = with_ctes(["nat"], f"""SELECT vault, CASE WHEN n % 12 = 11 THEN NULL ELSE '{CFG.name_prefix}' || n_name || '-v3' END AS name,
  upper(substr(n_name, 1, 3)) AS symbol, {asset_of('r')} AS asset FROM nat""")
ORACLE["asset_code_resolve"] = with_ctes(["vault_info"], "SELECT vault, asset, asset_code FROM vault_info")
ORACLE["vault_display_name"] = with_ctes(["vault_info"], "SELECT vault, vault_name FROM vault_info")
ORACLE["topic_filter"] = with_ctes(["all_events"], "SELECT contract_id, closed_at, transaction_hash FROM all_events WHERE event_type = 'view'")
ORACLE["event_classify"] = with_ctes(["all_events"], """SELECT transaction_hash, closed_at,
  CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'deposit' END AS event FROM all_events WHERE event_type IN ('purchase', 'error')""")
ORACLE["registry_semi_join"] = with_ctes(["all_events"], "SELECT contract_id, closed_at, transaction_hash FROM all_events WHERE topics_decoded LIKE '%" + _VT + "%'")
ORACLE["event_account"] = with_ctes(["ve_tx"], 'SELECT vault, tx_hash, to_addr AS "to" FROM ve_tx')
ORACLE["event_amount_sum"] = with_ctes(["ve_tx"], f"SELECT vault, tx_hash, {dec('tx_amt_u')} AS amount FROM ve_tx")
ORACLE["event_tvl"] = with_ctes(["ve_base"], f"SELECT vault, tx_hash, closed_at, {dec('tvl_u')} AS total_amount FROM ve_base WHERE event_id % 97 <> 0")
ORACLE["hourly_max"] = with_ctes(["tvl_hours"], "SELECT * FROM hourly")
ORACLE["dedup_prices"] = with_ctes(["prices"], "SELECT * FROM prices")
ORACLE["price_join"] = with_ctes(["tvl_hours"], "SELECT hour, vault, asset, asset_code, asset_price FROM tvl_hours")
ORACLE["usd_value"] = with_ctes(["tvl_hours"], "SELECT hour, vault, usd_tvl FROM tvl_hours")
ORACLE["daily_max"] = with_ctes(["filled"], "SELECT * FROM daily")
ORACLE["nonzero_keys"] = with_ctes(["filled"], "SELECT * FROM live_keys")
ORACLE["calendar"] = with_ctes(["filled"], "SELECT * FROM all_days")
ORACLE["dense_grid"] = with_ctes(["filled"], "SELECT day, vault, vault_name, asset, asset_code FROM grid")
ORACLE["grid_join"] = with_ctes(["filled"], "SELECT * FROM grid")
ORACLE["fill_groups"] = with_ctes(["filled"], "SELECT day, vault, nth AS grp FROM filled")
ORACLE["forward_fill"] = with_ctes(["filled"], "SELECT day, vault, asset_tvl, usd_tvl FROM filled")

ORACLE["materialize_dag"] = ORACLE["latest_usd_tvl"]

# ---- ledger JSON text, built from plain columns (for keys that output raw payloads) -----------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_i128(units: str, scalar: str = "false") -> str:
    lo = f"CAST(CASE WHEN ({units}) < 0 THEN CAST({units} AS HUGEINT) + 18446744073709551616 ELSE CAST({units} AS HUGEINT) END AS VARCHAR)"
    return (f"(CASE WHEN {scalar} THEN '{{\"i128\":\"' || CAST({units} AS VARCHAR) || '\"}}' "
            f"ELSE '{{\"i128\":{{\"hi\":' || CASE WHEN ({units}) < 0 THEN '-1' ELSE '0' END || ',\"lo\":' || {lo} || '}}}}' END)")


def s_addr(x: str) -> str:
    return f"('{{\"address\":\"' || {x} || '\"}}')"


def s_entry(sym: str, val: str) -> str:
    return f"('{{\"key\":{{\"symbol\":\"{sym}\"}},\"val\":' || {val} || '}}')"


def s_map(*entries: str) -> str:
    return "('{\"map\":[' || " + " || ',' || ".join(entries) + " || ']}')"


def s_vec(*elems: str) -> str:
    return "('{\"vec\":[' || " + " || ',' || ".join(elems) + " || ']}')"


def s_vec_joined(joined: str) -> str:
    return "('{\"vec\":[' || " + joined + " || ']}')"


_USER = "('G' || CAST(user_id AS VARCHAR))"
_SC = "(event_id % 3 = 0)"
_IDLE = "(tvl_u // 4)"
_FIRST_FUNDS = s_map(
    s_entry("asset", s_addr(asset_of("vnum % 5"))),
    s_entry("idle_amount", s_i128(_IDLE)),
    s_entry("invested_amount", s_i128(f"(tvl_u - {_IDLE})")),
    s_entry("strategy_allocations", s_vec(s_map(
        s_entry("amount", s_i128(f"(tvl_u - {_IDLE})")),
        s_entry("paused", "'{\"bool\":false}'"),
        s_entry("strategy_address", s_addr(strat_of("vnum"))),
    ))),
    s_entry("total_amount", s_i128("tvl_u")),
)
_SECOND_FUNDS = s_map(
    s_entry("asset", s_addr("'CA9'")),
    s_entry("idle_amount", s_i128("(event_id * 1000)")),
    s_entry("invested_amount", s_i128("0")),
    s_entry("strategy_allocations", "'{\"vec\":[]}'"),
    s_entry("total_amount", s_i128("(event_id * 1000)")),
)
_FUNDS = (f"(CASE WHEN event_id % 97 = 0 THEN '{{\"vec\":[]}}' ELSE "
          + s_vec_joined(f"{_FIRST_FUNDS} || CASE WHEN event_id % 11 = 0 THEN ',' || {_SECOND_FUNDS} ELSE '' END") + " END)")
_AMOUNTS = s_vec_joined(f"{s_i128('amt_u', _SC)} || CASE WHEN event_id % 5 = 0 THEN ',' || {s_i128('100000')} ELSE '' END")
_SUPPLY = "(tvl_u * (1 + vnum % 3))"
_DEPOSIT = s_map(
    s_entry("amounts", _AMOUNTS), s_entry("depositor", s_addr(_USER)), s_entry("df_tokens_minted", s_i128(_SHARES_U)),
    s_entry("total_managed_funds_before", _FUNDS), s_entry("total_supply_before", s_i128(_SUPPLY)),
)
_WITHDRAW = s_map(
    s_entry("amounts_withdrawn", _AMOUNTS), s_entry("df_tokens_burned", s_i128(_SHARES_U)),
    s_entry("total_managed_funds_before", _FUNDS), s_entry("total_supply_before", s_i128(_SUPPLY)),
    s_entry("withdrawer", s_addr(_USER)),
)
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_FEES = s_map(s_entry("distributed_fees", s_vec_joined(
    "array_to_string(list_transform(range(0, event_id % 3 + 1), lambda i: "
    + s_vec(s_addr("('CA' || CAST(i AS VARCHAR))"), s_i128(f"({_CENTS} * 1000 * (i + 1))", "((event_id + i) % 4 = 0)"))
    + "), ',')")))
_STRAT = strat_of("event_id")
_HARVEST = s_map(s_entry("amount", s_i128("amt_u", _SC)), s_entry("from", s_addr(_USER)),
                 s_entry("price_per_share", s_i128("(10000000 + event_id)", _SC)))
_PAUSE = s_map(s_entry("caller", s_addr(_USER)), s_entry("strategy_address", s_addr(_STRAT)))
_REPORT = s_map(s_entry("gains_or_losses", s_i128("amt_u")), s_entry("locked_fee", s_i128("0")), s_entry("prev_balance", s_i128("tvl_u")))
_UNWIND = s_map(s_entry("call_params", s_vec(s_vec(s_addr(_STRAT), s_i128("amt_u"), s_addr("contract_id")))), s_entry("report", _REPORT))
_MOVES = s_vec(s_map(s_entry("amount", s_i128("amt_u")), s_entry("strategy", s_addr(_STRAT))))
_INVEST = s_map(s_entry("asset_investments", s_vec(s_map(s_entry("asset", s_addr(asset_of("vnum % 5"))), s_entry("strategy_investments", _MOVES)))),
                s_entry("report", _REPORT))
_NEXT_USER = s_addr(user_of(1))
_ASSET_IN = s_addr(asset_of("vnum % 5"))
_SWAP = s_map(s_entry("swap_args", s_vec_joined(
    " || ',' || ".join([_ASSET_IN, s_addr("'CA9'"), s_i128("amt_u", _SC), s_i128("(amt_u + event_id)"), "'{\"u64\":' || CAST(event_id + 1700000000 AS VARCHAR) || '}'"])
    + f" || CASE WHEN event_id % 2 = 0 THEN ',' || {s_vec(_ASSET_IN, s_addr(q('CA8')), s_addr(q('CA9')))} ELSE '' END")))
_ROLES = ("'{\"map\":[' || " + " || ',' || ".join(f"'{{\"key\":{{\"u32\":{i}}},\"val\":' || {s_addr(user_of(i))} || '}}'" for i in range(3))
          + f" || CASE WHEN event_id % 2 = 0 THEN ',{{\"key\":{{\"u32\":3}},\"val\":' || {s_addr(user_of(3))} || '}}' ELSE '' END || ']}}'")
_MEMBERS = s_vec(s_map(s_entry("address", s_addr(_STRAT)), s_entry("name", "'{\"string\":\"main\"}'"),
                       s_entry("paused", "CASE WHEN event_id % 4 = 0 THEN '{\"bool\":true}' ELSE '{\"bool\":false}' END")))
_ASSETS = s_vec_joined(
    s_map(s_entry("address", _ASSET_IN), s_entry("strategies", _MEMBERS)) + " || CASE WHEN event_id % 3 = 0 THEN ',' || "
    + s_map(s_entry("address", s_addr("'CA9'")), s_entry("strategies", "'{\"vec\":[]}'")) + " ELSE '' END")
_MOVED = s_map(s_entry("amount", s_i128("amt_u", _SC)), s_entry("from", s_addr(_USER)))


def s_u32(x: str) -> str:
    return f"('{{\"u32\":' || CAST({x} AS VARCHAR) || '}}')"


_SIGNUP_JSON = [
    _PAUSE, _PAUSE, _UNWIND, _INVEST,
    s_map(s_entry("caller", s_addr(_USER)), s_entry("new_fee_receiver", _NEXT_USER)),
    s_map(s_entry("new_manager", _NEXT_USER)), s_map(s_entry("new_emergency_manager", _NEXT_USER)), s_map(s_entry("new_rebalance_manager", _NEXT_USER)),
    _SWAP, _SWAP,
    s_map(s_entry("assets", _ASSETS), s_entry("roles", _ROLES), s_entry("vault_fee", s_u32("event_id % 1000"))),
    s_map(s_entry("new_admin", _NEXT_USER)), s_map(s_entry("new_receiver", _NEXT_USER)), s_map(s_entry("new_fee", s_u32("event_id % 10000"))),
    s_map(s_entry("new_vault_wasm_hash", "'{\"bytes\":\"' || md5(CAST(event_id AS VARCHAR)) || '\"}'")),
    _MOVED, _MOVED, s_i128("amt_u", _SC),
]
register_cte("ev_json", f"""ev_json AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN {_DEPOSIT} WHEN 'error' THEN {_WITHDRAW} WHEN 'view' THEN {_FEES}
       WHEN 'click' THEN {_HARVEST} ELSE CASE event_id % 18 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SIGNUP_JSON))} END
     END AS data_decoded
  FROM ev_units)""", ["ev_units"])
ORACLE["recent_events"] = with_ctes(["ev_json"], """SELECT contract_id, closed_at, transaction_hash, topics_decoded, data_decoded FROM ev_json
WHERE contract_id = 'CV0003' AND topics_decoded LIKE '%deposit%' AND successful
ORDER BY closed_at DESC, transaction_hash LIMIT 100""")
ORACLE["inspect_raw_decoded"] = with_ctes(["ev_json"], """SELECT closed_at, transaction_hash, to_base64(encode(topics_decoded)) AS topics, topics_decoded,
  to_base64(encode(data_decoded)) AS data, data_decoded FROM ev_json ORDER BY closed_at DESC, transaction_hash LIMIT 5""")
_NAME_VAL = f"CASE WHEN n % 12 = 11 THEN '{{\"void\":null}}' ELSE '{{\"string\":\"' || {q(CFG.name_prefix)} || n_name || '-v3\"}}' END"
_INSTANCE = ("('{\"contract_instance\":{\"executable\":{\"wasm\":\"00\"},\"storage\":[{\"key\":{\"symbol\":\"Metadata\"},\"val\":' || "
             + s_map(s_entry("decimals", "'{\"u32\":7}'"), s_entry("name", _NAME_VAL),
                     s_entry("symbol", "('{\"string\":\"' || upper(substr(n_name, 1, 3)) || '\"}')"))
             + " || '},{\"key\":{\"symbol\":\"AssetStrategySet\"},\"val\":' || "
             + s_map(s_entry("address", s_addr(asset_of("r"))), s_entry("strategies", "'{\"vec\":[]}'"))
             + " || '}]}}')")
ORACLE["events_latest_state"] = with_ctes(["all_events", "nat"], f"""SELECT e.contract_id, e.closed_at, e.topics_decoded, s.state AS contract_metadata
FROM all_events e JOIN (
  SELECT vault AS contract_id, {_INSTANCE} AS state FROM nat
  UNION ALL
  SELECT {asset_of('r_regionkey')}, '{{"contract_instance":{{"executable":{{"stellar_asset":null}},"storage":[]}}}}' FROM region) s
ON s.contract_id = e.contract_id WHERE e.successful""")
_REPORT_SC = "(l_linenumber % 3 = 0)"
_REPORT_KEY = "('{\"vec\":[{\"symbol\":\"Report\"},' || " + s_addr(strat_of("l_partkey")) + " || ']}')"
_REPORT_VAL = s_map(
    s_entry("gains_or_losses", s_i128("((CAST(round(l_discount * 100) AS BIGINT) - 5) * 100000)", _REPORT_SC)),
    s_entry("locked_fee", s_i128("(CAST(round(l_tax * 100) AS BIGINT) * 100000)", _REPORT_SC)),
    s_entry("prev_balance", s_i128("(CAST(round(l_extendedprice * 100) AS BIGINT) * 100000)", _REPORT_SC)),
)
ORACLE["explore_reports"] = f"""SELECT * FROM (
  SELECT {vault_of('l_suppkey % 25')} AS vault, l_shipdate AS closed_at, l_orderkey AS ledger_sequence,
    'ScValTypeScvVec' AS contract_key_type, {_REPORT_KEY} AS key_decoded, {_REPORT_VAL} AS val_decoded, l_orderkey AS last_modified_ledger
  FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 25 < 5) r
ORDER BY closed_at DESC, ledger_sequence DESC, vault, key_decoded, val_decoded LIMIT 10"""
ORACLE["preview"] = with_ctes(["vault_events"], """SELECT *, (SELECT count(*) FROM vault_events) AS total_rows FROM vault_events
ORDER BY closed_at DESC NULLS LAST, vault DESC NULLS LAST, vault_name DESC NULLS LAST, asset DESC NULLS LAST, asset_code DESC NULLS LAST,
  event DESC NULLS LAST, "to" DESC NULLS LAST, amount DESC NULLS LAST, total_amount DESC NULLS LAST, closed_at_hour DESC NULLS LAST,
  tx_hash DESC NULLS LAST LIMIT 10""")

# ---- streaming ---------------------------------------------------------------------------------
register_cte("stream_flows", f"""stream_flows AS (
  SELECT closed_at, contract_id AS vault, transaction_hash AS tx_hash,
    CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'deposit' END AS event, 'G' || CAST(user_id AS VARCHAR) AS account,
    {dec('amt_u + CASE WHEN event_id % 5 = 0 THEN 100000 ELSE 0 END')} AS amount,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE {dec('tvl_u')} END AS total_amount
  FROM ev_units WHERE event_type IN ('purchase', 'error'))""", ["ev_units"])
ORACLE["stream_decode"] = with_ctes(["stream_flows"], "SELECT * FROM stream_flows")
ORACLE["stream_net_flow"] = with_ctes(["stream_flows"], """SELECT date_trunc('day', closed_at) AS day,
  sum(CASE WHEN event = 'deposit' THEN amount ELSE -amount END) AS net_flow, count(*) AS events FROM stream_flows GROUP BY 1""")
ORACLE["stream_hourly_tvl"] = with_ctes(["stream_flows"], """SELECT vault, date_trunc('hour', closed_at) AS hour, max(total_amount) AS max_tvl,
  count(*) AS readings FROM stream_flows WHERE total_amount IS NOT NULL GROUP BY 1, 2""")
ORACLE["stream_alerts"] = with_ctes(["stream_flows"], """SELECT vault, closed_at, 'large_withdrawal' AS kind, total_amount AS prev_tvl, amount AS tvl
FROM stream_flows WHERE event = 'withdraw' AND total_amount > 0 AND CAST(amount AS DOUBLE) / CAST(total_amount AS DOUBLE) >= 0.001
UNION ALL
SELECT vault, closed_at, 'tvl_drop', prev_tvl, tvl FROM (
  SELECT vault, closed_at, total_amount AS tvl,
    lag(total_amount) OVER (PARTITION BY vault ORDER BY closed_at, tx_hash, total_amount) AS prev_tvl
  FROM stream_flows WHERE total_amount IS NOT NULL) x
WHERE prev_tvl > 0 AND (CAST(tvl AS DOUBLE) - CAST(prev_tvl AS DOUBLE)) / CAST(prev_tvl AS DOUBLE) * 100 <= -50.0
UNION ALL
SELECT vault, min(closed_at), 'new_vault', CAST(NULL AS DECIMAL(38,7)), CAST(NULL AS DECIMAL(38,7)) FROM stream_flows GROUP BY vault""")
ORACLE["strategy_subset"] = with_ctes(["strategies", "clicks"], f"""SELECT s.strategy_name, s.strategy_address, s.asset_token,
  CAST(count(c.event_id) AS BIGINT) AS harvests, min(c.closed_at) AS first_harvest, max(c.closed_at) AS last_harvest
FROM strategies s LEFT JOIN clicks c ON c.contract_id = s.strategy_address
WHERE s.strategy_name LIKE '%yieldblox_strategy%' AND s.asset_token IN ({APY_ASSET_LIST})
GROUP BY s.strategy_name, s.strategy_address, s.asset_token""")
