"""Checks of whole jobs: event logs to facts and roll-ups, and the roll-ups on both schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.checks import rollups as R
from tradeweft.checks import state as S
from tradeweft.checks.base import QUOTES, check
from tradeweft.checks.chain import _PAD, _W
from tradeweft.operators import candles as C
from tradeweft.operators import movers as MV
from tradeweft.operators import pools as PL
from tradeweft.plans import chain as CH
from tradeweft.plans import retract as RT
from tradeweft.plans import rollups as RB
from tradeweft.session import session_dir

# --- event logs to facts: the swaps of the fixture as logs of two protocols, 6 decimals ------------
_POOL = "concat('0x', lpad(hex(CAST(substring(pool_address, 6) AS BIGINT) + 256), 40, '0'))"
_QUOTE = "CASE WHEN token_b = 'OTHER' AND token_a <> 'T2' THEN 'T2' ELSE token_b END"
_REFS = [("USDC", "none"), ("SOL", "0x" + "100".zfill(40)), ("T2", "0x" + "102".zfill(40))]


def _evm_logs(t):
    word = lambda x: _W.format(f"CAST({x} AS BIGINT)")
    a, b = "round(amount_a * 1000000)", "round(amount_b * 1000000)"
    into, out = (lambda x: f"CASE WHEN {x} > 0 THEN {x} ELSE 0 END"), (lambda x: f"CASE WHEN {x} < 0 THEN -({x}) ELSE 0 END")
    v2 = ", ".join(word(x) for x in (into(a), into(b), out(a), out(b)))
    v3 = ", ".join(word(x) for x in (a, b, "block_number + 1", "block_number * 13", "block_number % 401 - 200"))
    who = _PAD.format("lower(hex(block_number + 1))")
    kind = "CAST(substring(pool_address, 6) AS BIGINT) % 2 = 0"
    topic = f"CASE WHEN {kind} THEN '{K.TOPIC_SWAP['uniswap_v3']}' ELSE '{K.TOPIC_SWAP['uniswap_v2']}' END"
    return t.sql(f"""SELECT block_number, timestamp, lower({_POOL}) AS address, {topic} AS topic0, array({topic}, {who}, {who}) AS topics,
        CASE WHEN {kind} THEN concat('0x', {v3}) ELSE concat('0x', {v2}) END AS data, concat('0xtx', CAST(block_number AS STRING)) AS transaction_hash,
        transaction_index, log_index FROM {{e}}""", e=t.evm)


def _evm_dims(t):
    pools = t.sql(f"""SELECT DISTINCT 'base' AS network, 'dex' AS dex_name, CASE WHEN CAST(substring(pool_address, 6) AS BIGINT) % 2 = 0
        THEN 'uniswap_v3' ELSE 'uniswap_v2' END AS protocol, lower({_POOL}) AS pool, token_a, {_QUOTE} AS token_b, '0xf' AS factory_address, CAST(NULL AS INT) AS tick_spacing,
        CAST(NULL AS INT) AS fee, CAST(NULL AS BOOLEAN) AS stable, CAST(0 AS BIGINT) AS block_number, 0 AS transaction_index, 0 AS log_index, '' AS transaction_hash FROM {{e}}""", e=t.evm)
    tokens = t.sql(f"SELECT DISTINCT x AS address, 6 AS decimals, concat('SYM_', x) AS symbol FROM (SELECT token_a AS x FROM {{e}} UNION ALL SELECT {_QUOTE} FROM {{e}})", e=t.evm)
    senders = t.sql("SELECT concat('0xtx', CAST(block_number AS STRING)) AS hash, account AS `from` FROM {e}", e=t.evm)
    return pools, tokens, senders


def _evm_facts(t):
    pools, tokens, senders = _evm_dims(t)
    swaps = CH.evm_swaps(_evm_logs(t), senders, "base", tokens, pools)["swaps"]
    return CH.evm_facts(swaps, "base", order=["block_number"], refs=_REFS)


# Money times 1,000: exact values have up to eight decimals, and rounding to six would meet ties.
# Prices as in the chained price query, then first-in-first-out positions of both sides.
_PRICED = S.T8_CTE + """,
pp AS (SELECT v.n, v.timestamp, v.account, v.pool_address, v.token_a, v.token_b, v.amount_a, v.amount_b, coalesce(p.ratio * pb, 0) AS pa, coalesce(pb, 0) AS pb
  FROM v LEFT JOIN p ON p.n = v.n)"""
_LEGS = """SELECT account, token_a AS token, n, amount_a < 0 AS buy, CAST(abs(amount_a) AS DECIMAL(18,6)) AS q, CAST(pa AS DOUBLE) AS p FROM pp WHERE pa > 0
  UNION ALL SELECT account, token_b, n, amount_a > 0, CAST(abs(amount_b) AS DECIMAL(18,6)), CAST(pb AS DOUBLE) FROM pp WHERE pa > 0"""
_FIFO = S._FIFO.format(legs=_LEGS).replace("sum(u * (sp - lp)) AS pnl FROM", "sum(u * (sp - lp)) AS pnl, sum(u * lp) AS spent FROM").replace(
    "FILTER (pnl > 0)", "FILTER (pnl > spent * 1e-12)").replace("FILTER (pnl <= 0)", "FILTER (pnl <= spent * 1e-12)")
check("plan_evm_facts", lambda t: _evm_facts(t).select(
      "block_number", "account", "token_a", "token_b", "token_a_symbol", "amount_a", "amount_b", "token_b_usdc_price", "token_a_balance",
      *[(F.col(f"token_a_{c}_usdc") * 1000).alias(f"token_a_{c}_usdc_x1000") for c in ("cost", "profit")], "token_a_wins", "token_a_loses", "token_b_balance", "token_b_wins", "dex", "sign"),
      f"""WITH {_PRICED}, {_FIFO}
FINAL SELECT pp.n AS block_number, pp.account, token_a, token_b, 'SYM_' || token_a AS token_a_symbol, amount_a, amount_b, pb AS token_b_usdc_price,
      coalesce(fa.balance, 0) AS token_a_balance, coalesce(fa.cost, 0) * 1000 AS token_a_cost_usdc_x1000, coalesce(fa.profit, 0) * 1000 AS token_a_profit_usdc_x1000,
      coalesce(fa.wins, 0) AS token_a_wins, coalesce(fa.losses, 0) AS token_a_loses, coalesce(fb.balance, 0) AS token_b_balance, coalesce(fb.wins, 0) AS token_b_wins,
      'dex' AS dex, 1 AS sign
      FROM pp LEFT JOIN fifo fa ON fa.n = pp.n AND fa.token = pp.token_a LEFT JOIN fifo fb ON fb.n = pp.n AND fb.token = pp.token_b""",
      "amount_a amount_b token_b_usdc_price token_a_balance token_a_cost_usdc_x1000 token_a_profit_usdc_x1000 token_b_balance", "token_a_wins token_a_loses token_b_wins sign")
check("plan_evm_rollups", lambda t: RB.rebuild(_evm_facts(t), buy_sign=-1, quotes=["USDC", "USDT", "SOL"])["candles_1m"].groupBy(
      F.date_trunc("day", "bucket_ts").alias("day"), "pool_address", "token").agg(
      F.sum("swap_count").alias("swap_count"), F.sum("buy_count").alias("buy_count"), (F.sum("volume_usdc") * 1000).alias("volume_usdc_x1000"), F.count(F.lit(1)).alias("candles")),
      f"""WITH {_PRICED}
FINAL SELECT date_trunc('day', timestamp) AS day, '0x' || lpad(lower(to_hex(CAST(substring(pool_address, 6) AS BIGINT) + 256)), 40, '0') AS pool_address, token_a AS token, count(*) AS swap_count,
      count(*) FILTER (amount_a < 0) AS buy_count, sum(abs(amount_b * pb)) * 1000 AS volume_usdc_x1000, count(DISTINCT date_trunc('minute', timestamp)) AS candles
      FROM pp WHERE pa > 0 GROUP BY 1, 2, 3""", "volume_usdc_x1000", "swap_count buy_count candles")


# --- the same roll-ups on rows with an instruction path in place of a log index --------------------
def _paths(df):
    """Blocks rise with time here, so both schemas have one order."""
    return df.withColumns({"block_number": F.unix_micros("timestamp"), "instruction_address": F.array("log_index", F.lit(1))}).drop("log_index")


check("a5_candles10s_paths", lambda t: R._drop10(C.candles10s(_paths(t.swaps))), R._C10.format(w="10 seconds"), R._C10D, "swap_count")
check("a5_candles_2h_paths", lambda t: R._drop10(C.candles10s(_paths(t.swaps), "2 hours")), R._C10.format(w="2 hours"), R._C10D, "swap_count")
check("a10_last_prices_paths", lambda t: PL.last_prices(_paths(t.swaps), QUOTES).drop("order_key"),
      f"WITH {R._LAST}\nFINAL SELECT token_a, token_b, pool_address, swap_timestamp, price_usdc FROM last", "price_usdc")
check("a16_daily_movers_paths", lambda t: R._drop(MV.daily_movers(_paths(t.xs), QUOTES)), f"WITH {R._MOV}\nFINAL SELECT * EXCLUDE (k0, k1) FROM mv",
      "open_price_usdc close_price_usdc volume_usdc")
check("a18_tokens_by_creation_paths", lambda t: MV.tokens_by_creation(_paths(t.xs)),
      "SELECT token_a AS token_address, min(token_a_symbol) AS token_symbol, min(token_a_creation_date) AS creation_date, min(timestamp) AS first_swap_date FROM xs GROUP BY 1")
_ALL_BEST = f"WITH {R._STATS}, {R._BEST}, {R._LAST}, lp AS (SELECT token_a, arg_max(pool_address, k) AS p FROM last GROUP BY 1)"
check("a10_last_best_prices_all", lambda t: PL.last_best_prices(PL.last_prices(t.swaps, QUOTES), R._best(t)),
      f"""{_ALL_BEST}
FINAL SELECT l.token_a AS token, l.pool_address, b.pool_address AS best_pool_address, l.price_usdc FROM last l LEFT JOIN best b ON b.token_a = l.token_a
      JOIN lp ON lp.token_a = l.token_a WHERE l.pool_address = coalesce(b.pool_address, lp.p)""", "price_usdc")


# --- every roll-up of a rebuild, as its rows and a total ---------------------------------------------
_MEASURE = {"candles_1m": "volume_usdc", "candles_1m_1usd": "volume_usdc", "candles_10s": "volume_usdc", "token_swap_counts": "swap_count",
            "pool_stats_1h": "volume_1h_usdc", "last_prices": "price_usdc", "daily_movers": "volume_usdc", "tokens_by_creation": "1"}


def _totals(rollups):
    parts = [df.agg(F.lit(name).alias("rollup"), F.count(F.lit(1)).alias("n"), F.sum(F.expr(_MEASURE[name]).cast("double")).alias("total"))
             for name, df in rollups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_CANDLES = R._CANDLE.format(unit="minute", cond="{cond}")
_TOTALS = f"""WITH {R._STATS}, {R._LAST}, {R._MOV},
c1 AS ({_CANDLES.format(cond="").replace("FROM evm", "FROM swaps")}), c2 AS ({_CANDLES.format(cond="AND abs(amount_a * token_a_usdc_price) >= 1").replace("FROM evm", "FROM swaps")}),
c3 AS ({R._C10.format(w="10 seconds")})
FINAL SELECT 'candles_1m' AS rollup, count(*) AS n, sum(volume_usdc) AS total FROM c1 UNION ALL SELECT 'candles_1m_1usd', count(*), sum(volume_usdc) FROM c2
UNION ALL SELECT 'candles_10s', count(*), sum(volume_usdc) FROM c3
UNION ALL SELECT 'token_swap_counts', count(DISTINCT token), count(*) FROM (SELECT token_a AS token FROM swaps UNION ALL SELECT token_b FROM swaps)
UNION ALL SELECT 'pool_stats_1h', count(*), sum(volume_1h_usdc) FROM st UNION ALL SELECT 'last_prices', count(*), sum(price_usdc) FROM last
UNION ALL SELECT 'daily_movers', count(*), sum(volume_usdc) FROM mv UNION ALL SELECT 'tokens_by_creation', count(DISTINCT token_a), count(DISTINCT token_a) FROM swaps"""
check("s17_rebuild_all", lambda t: _totals(RB.rebuild(t.xs, buy_sign=1, quotes=QUOTES)), _TOTALS, "total")
check("s17_rebuild_all_paths", lambda t: _totals(RB.rebuild(_paths(t.xs), buy_sign=1, quotes=QUOTES)), _TOTALS, "total")


# --- roll-ups after a roll-back and a replay: as if built from the rows that count now ---------------
def _rolled_back(t):
    """All rows are stored; those of the last two fifths go, and half of them come again with other amounts and prices."""
    folder = f"{session_dir(t.spark)}/rollups-{uuid.uuid4().hex}"
    rows = t.xs
    last = rows.agg(F.max("block_number")).first()[0] * 3 // 5
    RT.store(rows, folder, 1, QUOTES)
    replay = rows.filter((F.col("block_number") >= last) & (F.col("block_number") % 2 == 0)).withColumns(
        {"amount_b": F.col("amount_b") * 2, "token_a_usdc_price": F.col("token_a_usdc_price") / 2})
    RT.roll_back(rows, folder, last, replay, 1, QUOTES)
    return _totals({name: RT.stored(t.spark, folder, name) for name in _MEASURE})


_NOW = """swaps_now AS (SELECT * REPLACE (if(block_number >= cut, amount_b * 2, amount_b) AS amount_b, if(block_number >= cut, token_a_usdc_price / 2, token_a_usdc_price) AS token_a_usdc_price)
  FROM swaps, (SELECT max(block_number) * 3 // 5 AS cut FROM swaps) WHERE block_number < cut OR block_number % 2 = 0),
xs_now AS (SELECT x.* REPLACE (s.amount_b AS amount_b, s.token_a_usdc_price AS token_a_usdc_price) FROM xs x JOIN swaps_now s ON s.block_number = x.block_number),
tvl_now AS (SELECT *, abs(pool_token_a_reserve * token_a_usdc_price) + abs(pool_token_b_reserve * token_b_usdc_price) AS pool_tvl FROM swaps_now),
"""
_AFTER = _TOTALS[5:].replace("FROM swaps", "FROM swaps_now").replace("FROM xs", "FROM xs_now").replace("FROM tvl", "FROM tvl_now")
check("t11_rollback_rollups", _rolled_back, f"WITH {_NOW}{_AFTER}", "total")
