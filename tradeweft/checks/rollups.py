"""Checks of candles, pools, movers, traders, filters and row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeweft.checks.base import END, NOW, Q_SQL, QUOTES, START, check, now
from tradeweft.functions import keys as OK
from tradeweft.functions import market as M
from tradeweft.functions import num as N
from tradeweft.functions import time as TM
from tradeweft.operators import candles as C
from tradeweft.operators import dedup as D
from tradeweft.operators import filters as P
from tradeweft.operators import movers as MV
from tradeweft.operators import ordered as O
from tradeweft.operators import pools as PL
from tradeweft.operators import pricing as PR
from tradeweft.operators import traders as TR
from tradeweft.plans import rollups as RB
from tradeweft.sources import tables as TB

KEY = "row(timestamp, transaction_index, log_index)"
_OHLC = "open high low close"


# --- sources and layouts -------------------------------------------------------------
check("s5_block_range", lambda t: P.block_range(t.swaps, 100, 5000).select("block_number", "account", "amount_a"),
      "SELECT block_number, account, amount_a FROM swaps WHERE block_number BETWEEN 100 AND 5000", "amount_a")
check("s7_swap_rows", lambda t: TB.swaps_evm_rows(t.evm).groupBy("token_a", "a_b_swapped", "sign").agg(
      F.count(F.lit(1)).alias("n"), F.sum("amount_a").alias("amount_a"), F.count("pool_tick").alias("ticks")),
      "SELECT token_a, CAST(NULL AS BOOLEAN) AS a_b_swapped, 1 AS sign, count(*) AS n, sum(amount_a) AS amount_a, 0 AS ticks FROM evm GROUP BY token_a",
      "amount_a", "sign ticks")
check("s8_swap_rows_defaults", lambda t: TB.swaps_solana_rows(t.swaps.withColumn(
      "token_a_symbol", F.when(F.col("token_a") == "T1", "ONE"))).select(
      "block_number", "token_a_symbol", "token_b_symbol", "token_a_creation_date", "token_a_pricing_pool",
      "token_a_wins", "pool_tvl_usdc"),
      """SELECT block_number, CASE WHEN token_a = 'T1' THEN 'ONE' ELSE '[unknown]' END AS token_a_symbol,
         '[unknown]' AS token_b_symbol, TIMESTAMP '1970-01-01' AS token_a_creation_date, '' AS token_a_pricing_pool,
         0 AS token_a_wins, pool_tvl AS pool_tvl_usdc FROM tvl""", "pool_tvl_usdc", "token_a_wins")
for _layout, _key in (("time", "timestamp"), ("pool", "pool_address"), ("account", "account")):
    check(f"s12_layout_{_layout}", lambda t, y=_layout, k=_key: TB.clustered_copy(t.swaps, y)
          .groupBy("yyyymm").agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi")),
          f"SELECT year(timestamp) * 100 + month(timestamp) AS yyyymm, count(*) AS n, min({_key}) AS lo, max({_key}) AS hi FROM swaps GROUP BY 1",
          "", "yyyymm")
check("s12_layout_token", lambda t: TB.clustered_copy(t.transfers, "token").groupBy("yyyymm").agg(
      F.count(F.lit(1)).alias("n"), F.min("token").alias("lo"), F.max("token").alias("hi")),
      "SELECT year(timestamp) * 100 + month(timestamp) AS yyyymm, count(*) AS n, min(token) AS lo, max(token) AS hi FROM transfers GROUP BY 1", "", "yyyymm")
check("s13_account_copy", lambda t: TB.account_copy(t.swaps), """SELECT timestamp, account, token_a, token_b, amount_a, amount_b,
      token_a_usdc_price, token_b_usdc_price, transaction_index, log_index, sign FROM swaps
      WHERE token_a_usdc_price > 0 AND token_b_usdc_price > 0""",
      "amount_a amount_b token_a_usdc_price token_b_usdc_price", "transaction_index log_index sign")
check("s14_positions_source", lambda t: TB.account_positions_source(
      t.swaps, QUOTES, ["block_number", "transaction_index", "log_index"]).drop("sign"),
      f"""SELECT timestamp, account, token_a, token_b, amount_a, amount_b, token_a_usdc_price, token_b_usdc_price,
      block_number, transaction_index, log_index FROM swaps WHERE (amount_a > 0 OR amount_b > 0) AND token_b IN {Q_SQL}""",
      "amount_a amount_b token_a_usdc_price token_b_usdc_price", "transaction_index log_index")
check("s15_retain", lambda t: P.retain(t.swaps, "timestamp", 10, now()).select("block_number", "timestamp"),
      f"SELECT block_number, timestamp FROM swaps WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
check("s17_rebuild", lambda t: RB.rebuild(t.xs, buy_sign=1, quotes=QUOTES)["token_swap_counts"],
      "SELECT token, sum(sign) AS swap_count FROM (SELECT token_a AS token, sign FROM swaps UNION ALL SELECT token_b, sign FROM swaps) GROUP BY token",
      "", "swap_count")

# --- filters and projections -----------------------------------------------------------
check("p11_human_amount", lambda t: t.swaps.select("block_number", N.human_amount(
      F.col("block_number") * 1000003, F.when(F.col("log_index") > 0, F.col("log_index"))).alias("amount")),
      """SELECT block_number, CAST(block_number * 1000003 AS DOUBLE) / pow(10.0, CASE WHEN log_index > 0 THEN log_index ELSE 18 END) AS amount
      FROM swaps""", "amount")
check("p12_orient_pair_evm", lambda t: P.orient_pair_evm(t.evm, ["T1", "USDC", "T3", "SOL"]).select(
      "block_number", "token_a", "token_b", "amount_a", "amount_b", "pool_token_a_reserve", "a_b_swapped"),
      """WITH r AS (SELECT *, CASE token_a WHEN 'T1' THEN 0 WHEN 'USDC' THEN 1 WHEN 'T3' THEN 2 WHEN 'SOL' THEN 3 ELSE 9 END
          < CASE token_b WHEN 'T1' THEN 0 WHEN 'USDC' THEN 1 WHEN 'T3' THEN 2 WHEN 'SOL' THEN 3 ELSE 9 END AS sw FROM evm)
FINAL SELECT block_number, if(sw, token_b, token_a) AS token_a, if(sw, token_a, token_b) AS token_b,
      if(sw, amount_b, amount_a) AS amount_a, if(sw, amount_a, amount_b) AS amount_b,
      if(sw, pool_token_b_reserve, pool_token_a_reserve) AS pool_token_a_reserve, sw AS a_b_swapped FROM r""",
      "amount_a amount_b pool_token_a_reserve")
check("p13_orient_pair_quote", lambda t: P.orient_pair_quote(t.swaps, ["SOL", "USDC", "USDT"]).select(
      "block_number", "token_a", "token_b", "amount_a"),
      """WITH r AS (SELECT *, CASE token_a WHEN 'SOL' THEN 0 WHEN 'USDC' THEN 1 WHEN 'USDT' THEN 2 ELSE 9 END AS ra,
          CASE token_b WHEN 'SOL' THEN 0 WHEN 'USDC' THEN 1 WHEN 'USDT' THEN 2 ELSE 9 END AS rb FROM swaps)
FINAL SELECT block_number, if(sw, token_b, token_a) AS token_a, if(sw, token_a, token_b) AS token_b,
      if(sw, amount_b, amount_a) AS amount_a FROM (SELECT *, ra < rb OR (ra = rb AND token_a > token_b) AS sw FROM r)""", "amount_a")
check("p14_priceable_evm", lambda t: t.evm.filter(P.priceable_evm("USDC", ["USDC", "SOL"])).select("block_number", "token_b"),
      """SELECT block_number, token_b FROM evm WHERE token_b IN ('USDC','SOL') AND amount_a <> 0 AND amount_b <> 0
      AND sign(amount_a) <> sign(amount_b) AND (token_b <> 'USDC' OR abs(amount_b) BETWEEN 0.1 AND 10000)""")
check("p15_positionable", lambda t: t.swaps.filter(P.positionable(QUOTES)).select("block_number", "token_b"),
      f"SELECT block_number, token_b FROM swaps WHERE token_b IN {Q_SQL} AND amount_a <> 0 AND amount_b <> 0")
check("p16_filter_pairs", lambda t: P.filter_pairs(t.swaps, ["T1", "T2", "SOL"]).select("block_number", "token_a", "token_b"),
      "SELECT block_number, token_a, token_b FROM swaps WHERE token_a IN ('T1','T2','SOL') AND token_b IN ('T1','T2','SOL')")
check("p17_drop_accounts", lambda t: P.drop_accounts(t.swaps.withColumn(
      "account_keys", F.array("account", "pool_address")), ["acc_7", "pool_3"]).select("block_number", "account"),
      "SELECT block_number, account FROM swaps WHERE account <> 'acc_7' AND pool_address <> 'pool_3'")
check("p18_quality_filter", lambda t: P.quality_filter(t.swaps).select("block_number", "slippage_pct"),
      """SELECT block_number, slippage_pct FROM swaps WHERE slippage_pct < 10 AND abs(amount_b * token_b_usdc_price) >= 0.01
      AND amount_a <> 0 AND amount_b <> 0""", "slippage_pct")
check("p19_min_usd", lambda t: P.min_usd(t.swaps, 20.0).select("block_number"),
      "SELECT block_number FROM swaps WHERE abs(amount_a * token_a_usdc_price) >= 20")
check("p20_is_quote", lambda t: t.swaps.filter(M.is_quote(F.col("token_b"), QUOTES)).groupBy("token_b").agg(
      F.count(F.lit(1)).alias("n")), f"SELECT token_b, count(*) AS n FROM swaps WHERE token_b IN {Q_SQL} GROUP BY 1")
check("p21_usd_volume_tvl", lambda t: t.swaps.select("block_number", M.usd_volume().alias("volume_usdc"),
      M.pool_tvl().alias("pool_tvl_usdc")),
      "SELECT block_number, abs(amount_b * token_b_usdc_price) AS volume_usdc, pool_tvl AS pool_tvl_usdc FROM tvl",
      "volume_usdc pool_tvl_usdc")
check("p22_buy_signals", lambda t: P.buy_signals(t.swaps, START, END, QUOTES, 40.0, 55.0, limit=200),
      f"""SELECT timestamp, token_a AS token, pool_address AS pool, dex, token_a_usdc_price AS entry_price,
      abs(amount_b * token_b_usdc_price) AS size_usdc FROM swaps WHERE timestamp BETWEEN '{START}' AND '{END}'
      AND token_b IN {Q_SQL} AND abs(amount_b * token_b_usdc_price) > 55 AND token_a_usdc_price > 0 AND amount_a > 0
      ORDER BY timestamp, token, pool LIMIT 200""", "entry_price size_usdc")
check("p22_volume_breakouts", lambda t: P.volume_breakouts(t.swaps, START, END, QUOTES, 50.0),
      f"""SELECT timestamp, token_a AS token, pool_address AS pool, dex, token_a_usdc_price AS entry_price,
      abs(amount_b * token_b_usdc_price) AS size_usdc FROM swaps WHERE timestamp BETWEEN '{START}' AND '{END}'
      AND token_b IN {Q_SQL} AND abs(amount_b * token_b_usdc_price) > 50""", "entry_price size_usdc")

# --- candles -----------------------------------------------------------------------------
_CANDLE = """SELECT pool_address, token_a AS token, date_trunc('{unit}', timestamp) AS bucket_ts,
  sum(abs(amount_b * token_b_usdc_price) * sign) AS volume_usdc, sum(sign) AS swap_count,
  sum(if(amount_a < 0, sign, 0)) AS buy_count, sum(if(amount_a > 0, sign, 0)) AS sell_count,
  sum(if(amount_a < 0, abs(amount_a * token_a_usdc_price) * sign, 0)) AS buy_volume_usdc,
  sum(if(amount_a > 0, abs(amount_a * token_a_usdc_price) * sign, 0)) AS sell_volume_usdc,
  arg_min(token_a_usdc_price, """ + KEY + """) AS open, max(token_a_usdc_price) AS high,
  min(token_a_usdc_price) AS low, arg_max(token_a_usdc_price, """ + KEY + """) AS close
  FROM evm WHERE token_a_usdc_price > 0 {cond} GROUP BY 1, 2, 3"""
_CD = f"volume_usdc buy_volume_usdc sell_volume_usdc {_OHLC}"
_CL = "swap_count buy_count sell_count"
_drop = lambda df: df.drop("open_key", "close_key")
check("a1_candles_1m", lambda t: _drop(C.candles(t.evm, "1 minute")), _CANDLE.format(unit="minute", cond=""), _CD, _CL)
check("a1_candles_1h", lambda t: _drop(C.candles(t.evm, "1 hour")), _CANDLE.format(unit="hour", cond=""), _CD, _CL)
check("a2_candles_min_usd", lambda t: _drop(C.candles(t.evm, "1 hour", min_usd=20.0)),
      _CANDLE.format(unit="hour", cond="AND abs(amount_a * token_a_usdc_price) >= 20"), _CD, _CL)
check("a3_rollup_candles", lambda t: _drop(C.rollup_candles(C.candles(t.evm, "1 minute"), "24 hours")),
      "SELECT *, (close - open) / open AS rise FROM (" + _CANDLE.format(unit="day", cond="") + ")", _CD + " rise", _CL)
check("a4_candle_check", lambda t: C.candle_check(t.evm, "pool_3", "2024-01-10 08:00:00", "4 hours"),
      f"""SELECT sum(abs(amount_b * token_b_usdc_price) * sign) AS vol, count(*) AS count,
      arg_min(token_a_usdc_price, {KEY}) AS open, max(token_a_usdc_price) AS high, min(token_a_usdc_price) AS low,
      arg_max(token_a_usdc_price, {KEY}) AS close FROM evm WHERE pool_address = 'pool_3'
      AND timestamp >= TIMESTAMP '2024-01-10 08:00:00' AND timestamp < TIMESTAMP '2024-01-10 12:00:00'
      AND abs(amount_b) BETWEEN 0.1 AND 10000""", f"vol {_OHLC}")
_C10 = """SELECT pool_address, token_a, token_b, dex, time_bucket(INTERVAL '{w}', timestamp, TIMESTAMP '1970-01-01') AS bucket_ts,
  arg_min(token_a_usdc_price, """ + KEY + """) AS open_token_a_usdc, max(token_a_usdc_price) AS high_token_a_usdc,
  min(token_a_usdc_price) AS low_token_a_usdc, arg_max(token_a_usdc_price, """ + KEY + """) AS close_token_a_usdc,
  arg_min(token_b_usdc_price, """ + KEY + """) AS open_token_b_usdc, max(token_b_usdc_price) AS high_token_b_usdc,
  min(token_b_usdc_price) AS low_token_b_usdc, arg_max(token_b_usdc_price, """ + KEY + """) AS close_token_b_usdc,
  sum(sign) AS swap_count, sum(abs(amount_b * token_b_usdc_price) * sign) AS volume_usdc,
  avg(slippage_pct) AS avg_slippage_pct, max(pool_tvl) AS max_pool_tvl_usdc
  FROM tvl WHERE slippage_pct < 10 AND abs(amount_b * token_b_usdc_price) >= 0.01 AND amount_a <> 0 AND amount_b <> 0
  GROUP BY 1, 2, 3, 4, 5"""
_C10D = " ".join(f"{x}_token_{s}_usdc" for s in "ab" for x in ("open", "high", "low", "close")) \
    + " volume_usdc avg_slippage_pct max_pool_tvl_usdc"
_drop10 = lambda df: df.drop("open_key", "close_key", "slippage_sum", "slippage_count")
check("a5_candles10s", lambda t: _drop10(C.candles10s(t.swaps)), _C10.format(w="10 seconds"), _C10D, "swap_count")
check("a5_candles_2h", lambda t: _drop10(C.candles10s(t.swaps, "2 hours")), _C10.format(w="2 hours"), _C10D, "swap_count")
check("a6_token_swap_counts", lambda t: C.token_swap_counts(t.swaps),
      "SELECT token, sum(n) AS swap_count FROM (SELECT token_a AS token, count(*) AS n FROM swaps GROUP BY 1 UNION ALL SELECT token_b, count(*) FROM swaps GROUP BY 1) GROUP BY 1",
      "", "swap_count")
check("a7_buyers_sellers", lambda t: C.buyers_sellers(t.evm, "pool_5", now()),
      f"""SELECT count(DISTINCT CASE WHEN amount_a < 0 THEN account END) AS buyers,
      count(DISTINCT CASE WHEN amount_a > 0 THEN account END) AS sellers FROM evm WHERE pool_address = 'pool_5'
      AND timestamp >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR""")
def _sketched(t):
    """Exact distinct traders of a day beside the estimates of the stored hourly sketches."""
    day = C.merged_traders(C.trader_sketches(t.evm, "1 hour"), "1 day").withColumnRenamed("bucket_ts", "day")
    a, trader = F.col("amount_a"), F.col("account")
    exact = t.evm.groupBy("pool_address", TM.bucket(F.col("timestamp"), "1 day").alias("day")).agg(
        F.count_distinct(F.when(a < 0, trader)).alias("buyers"), F.count_distinct(F.when(a > 0, trader)).alias("sellers"))
    near = lambda c: F.abs(F.col(f"approx_{c}") - F.col(c)) <= F.greatest(F.lit(1.0), 0.05 * F.col(c))
    return exact.join(day, ["pool_address", "day"], "left").select(
        "pool_address", "day", "buyers", "sellers", near("buyers").alias("buyers_near"), near("sellers").alias("sellers_near"))


check("a7_trader_sketches", _sketched,
      """SELECT pool_address, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day, count(DISTINCT CASE WHEN amount_a < 0 THEN account END) AS buyers,
      count(DISTINCT CASE WHEN amount_a > 0 THEN account END) AS sellers, true AS buyers_near, true AS sellers_near FROM evm GROUP BY 1, 2""")
check("a30_swaps_per_bucket", lambda t: C.swaps_per_bucket(t.swaps),
      "SELECT token_a AS token, time_bucket(INTERVAL '5 minutes', timestamp, TIMESTAMP '1970-01-01') AS bucket_ts, count(*) AS swap_count FROM swaps GROUP BY 1, 2")

# --- pools and prices ---------------------------------------------------------------------
_STATS = f"""st AS (SELECT date_trunc('hour', timestamp) AS hour_ts, token_a, token_b, dex, pool_address,
  sum(abs(amount_b * token_b_usdc_price) * sign) AS volume_1h_usdc FROM swaps WHERE token_b IN {Q_SQL} GROUP BY 1,2,3,4,5)"""
_BEST = f"""best AS (SELECT token_a, token_b, dex, pool_address, v AS total_volume_usdc FROM (
  SELECT token_a, token_b, dex, pool_address, sum(volume_1h_usdc) AS v,
    row_number() OVER (PARTITION BY token_a ORDER BY sum(volume_1h_usdc) DESC, pool_address) AS rn
  FROM st WHERE hour_ts BETWEEN '{START}' AND '{END}' GROUP BY 1,2,3,4) WHERE rn = 1)"""
_stats = lambda t: PL.pool_stats_1h(t.swaps, QUOTES)
_best = lambda t: PL.best_quote_pools(_stats(t), START, END)
check("a8_pool_stats_1h", _stats, f"WITH {_STATS}\nFINAL SELECT * FROM st", "volume_1h_usdc")
check("a9_best_quote_pools", _best, f"WITH {_STATS}, {_BEST}\nFINAL SELECT * FROM best", "total_volume_usdc")
_LAST = f"""last AS (SELECT token_a, token_b, pool_address, max(timestamp) AS swap_timestamp, max({KEY}) AS k,
  arg_max(token_a_usdc_price, {KEY}) AS price_usdc FROM swaps WHERE token_a_usdc_price > 0 AND sign > 0
  AND token_b IN {Q_SQL} GROUP BY 1, 2, 3)"""
check("a10_last_prices", lambda t: PL.last_prices(t.swaps, QUOTES).drop("order_key"),
      f"WITH {_LAST}\nFINAL SELECT token_a, token_b, pool_address, swap_timestamp, price_usdc FROM last", "price_usdc")
check("a10_last_best_prices", lambda t: PL.last_best_prices(
      PL.last_prices(t.swaps, QUOTES), _best(t)),
      f"""WITH {_STATS}, {_BEST}, {_LAST}, lp AS (SELECT token_a, arg_max(pool_address, k) AS p FROM last GROUP BY 1)
FINAL SELECT l.token_a AS token, l.pool_address, b.pool_address AS best_pool_address, l.price_usdc
      FROM last l LEFT JOIN best b ON b.token_a = l.token_a JOIN lp ON lp.token_a = l.token_a
      WHERE l.pool_address = coalesce(b.pool_address, lp.p)""", "price_usdc")
check("j14_last_pool", lambda t: PL.last_prices(t.swaps, QUOTES).groupBy("token_a").agg(
      F.max_by("pool_address", "order_key").alias("pool_address")),
      f"WITH {_LAST}\nFINAL SELECT token_a, arg_max(pool_address, k) AS pool_address FROM last GROUP BY 1")
check("x3_last_best_prices_legacy", lambda t: PL.last_best_prices_legacy(
      t.swaps, _best(t), QUOTES),
      f"""WITH {_STATS}, {_BEST}
FINAL SELECT s.token_a AS token, arg_max(s.pool_address, {KEY}) AS pool_address,
      arg_max(b.pool_address, {KEY}) AS best_pool_address, arg_max(token_a_usdc_price, {KEY}) AS price_usdc
      FROM swaps s LEFT JOIN best b ON b.token_a = s.token_a WHERE token_a_usdc_price > 0 AND sign > 0
      AND CASE WHEN b.pool_address IS NOT NULL THEN s.pool_address = b.pool_address ELSE s.token_b IN {Q_SQL} END GROUP BY 1""",
      "price_usdc")
check("w13_rolling_best_pool", lambda t: PL.rolling_best_pool(_stats(t), 3),
      f"""WITH {_STATS}, ph AS (SELECT token_a, pool_address, hour_ts, sum(volume_1h_usdc) AS v FROM st GROUP BY 1,2,3),
h AS (SELECT DISTINCT token_a, hour_ts FROM st),
r AS (SELECT h.token_a, h.hour_ts, ph.pool_address, sum(ph.v) AS volume_usdc FROM h JOIN ph ON ph.token_a = h.token_a
      AND ph.hour_ts BETWEEN h.hour_ts - INTERVAL 3 DAY AND h.hour_ts GROUP BY 1,2,3)
FINAL SELECT token_a, hour_ts, pool_address AS best_pool, volume_usdc FROM (SELECT *, row_number() OVER (
      PARTITION BY token_a, hour_ts ORDER BY volume_usdc DESC, pool_address) AS rn FROM r) WHERE rn = 1""", "volume_usdc")

# --- traders ---------------------------------------------------------------------------------
_TTS = """SELECT account, token_a AS token, sum(if(amount_a {sell} 0, sign, 0)) AS sells,
  sum(if(amount_a {buy} 0, sign, 0)) AS buys, sum(if(amount_a {sell} 0, abs(amount_a) * sign, 0)) AS sold_amount,
  sum(if(amount_a {buy} 0, abs(amount_a) * sign, 0)) AS bought_amount, max(token_a_wins) AS tx_wins,
  max(token_a_loses) AS tx_loses, sum(token_a_profit_usdc * sign) AS total_profit_usdc,
  sum(if(amount_a {sell} 0, abs(amount_a) * sign, 0)) / nullif(sum(if(amount_a {buy} 0, abs(amount_a) * sign, 0)), 0) AS sold_to_bought_ratio
  FROM {src} WHERE timestamp BETWEEN '""" + START + "' AND '" + END + """' AND {cond} GROUP BY 1, 2"""
_EVM_COND, _SOL_COND = "token_a_usdc_price <> 0 AND token_b_usdc_price <> 0", f"token_b IN {Q_SQL}"
_tts_evm = _TTS.format(sell=">", buy="<", src="xe", cond=_EVM_COND)
_tts_sol = _TTS.format(sell="<", buy=">", src="xs", cond=_SOL_COND)
_TD, _TL = "sold_amount bought_amount total_profit_usdc sold_to_bought_ratio", "sells buys tx_wins tx_loses"
check("a11_trader_token_stats_evm", lambda t: TR.trader_token_stats_evm(t.xe, START, END), _tts_evm, _TD, _TL)
check("a13_trader_token_stats", lambda t: TR.trader_token_stats(t.xs, START, END, QUOTES), _tts_sol, _TD, _TL)
_TOP = """SELECT s.account, sum(sign) AS tx_count, avg(abs(amount_a) * token_a_usdc_price * sign) AS avg_trade_usdc,
  sum(if(amount_a {buy} 0, sign, 0)) AS buys, sum(if(amount_a {sell} 0, sign, 0)) AS sells,
  count(DISTINCT token_a) AS distinct_tokens, sum(token_a_cost_usdc * sign) AS total_cost_usdc,
  sum(token_a_profit_usdc * sign) AS total_profit_usdc, sum(token_a_wins * sign) AS tx_wins,
  sum(token_a_loses * sign) AS tx_loses, any_value(w.ww) AS tx_wins_total, any_value(w.ll) AS tx_loses_total,
  any_value(w.token_wins) AS token_wins, any_value(w.token_loses) AS token_loses,
  min(timestamp) AS first_tx, max(timestamp) AS last_tx FROM {src} s JOIN w ON w.account = s.account
  WHERE timestamp BETWEEN '""" + START + "' AND '" + END + """' AND {cond} GROUP BY 1"""
_W = """tts AS ({tts}), w AS (SELECT account, sum(tx_wins) AS ww, sum(tx_loses) AS ll,
  count(*) FILTER (total_profit_usdc > 0) AS token_wins, count(*) FILTER (total_profit_usdc < 0) AS token_loses FROM tts GROUP BY 1)"""
_RATIO = """tx_wins / nullif(tx_wins + tx_loses, 0) AS tx_win_ratio, token_wins / nullif(token_wins + token_loses, 0) AS token_win_ratio,
  total_profit_usdc / nullif(total_cost_usdc, 0) * 100 AS pnl_percent"""
_RD = "total_cost_usdc total_profit_usdc tx_win_ratio token_win_ratio pnl_percent"
_RL = "tx_count buys sells tx_wins tx_loses tx_wins_total tx_loses_total"
check("a12_top_traders_evm", lambda t: TR.top_traders_evm(t.xe, START, END),
      f"""WITH {_W.format(tts=_tts_evm)}, top AS ({_TOP.format(buy='<', sell='>', src='xe', cond=_EVM_COND)})
FINAL SELECT *, {_RATIO}, tx_count / nullif(date_diff('hour', first_tx, last_tx), 0) AS tx_per_hour FROM top""",
      _RD + " avg_trade_usdc tx_per_hour", _RL)
_HOLD = f"""bs AS (SELECT account, token_a, min(timestamp) FILTER (amount_a > 0) AS fb, min(timestamp) FILTER (amount_a < 0) AS fs,
  max(timestamp) FILTER (amount_a < 0) AS ls FROM xs WHERE timestamp BETWEEN '{START}' AND '{END}' AND {_SOL_COND} GROUP BY 1, 2),
ht AS (SELECT account, count(*) AS unique_tokens,
  avg(epoch(date_trunc('second', fs)) - epoch(date_trunc('second', fb))) AS avg_holding_time_to_first_sell,
  avg(epoch(date_trunc('second', ls)) - epoch(date_trunc('second', fb))) AS avg_holding_time_to_last_sell
  FROM bs WHERE fb IS NOT NULL AND fs >= fb GROUP BY 1)"""
_SOL_TOP = f"""WITH {_W.format(tts=_tts_sol)}, {_HOLD}, top AS ({_TOP.format(buy='>', sell='<', src='xs', cond=_SOL_COND)}),
full_top AS (SELECT top.* EXCLUDE (avg_trade_usdc), {_RATIO}, avg_holding_time_to_first_sell, avg_holding_time_to_last_sell
  FROM top JOIN ht USING (account))"""
_SD = _RD + " avg_holding_time_to_first_sell avg_holding_time_to_last_sell"
_top_sol = lambda t: TR.top_traders(t.xs, START, END, QUOTES)
check("a14_top_traders", _top_sol, _SOL_TOP + "\nFINAL SELECT * FROM full_top", _SD, _RL)
check("a15_holding_times", lambda t: TR.holding_times(P.between_times(t.xs, START, END).filter(M.is_quote(F.col("token_b"), QUOTES))),
      f"WITH {_HOLD}\nFINAL SELECT * FROM ht", "avg_holding_time_to_first_sell avg_holding_time_to_last_sell")
check("o2_ranked", lambda t: TR.ranked(_top_sol(t), "pnl_percent"), _SOL_TOP + "\nFINAL SELECT * FROM full_top ORDER BY pnl_percent DESC", _SD, _RL)
check("o3_top_k", lambda t: TR.top_k(_top_sol(t), (F.col("pnl_percent") > -50) & (F.col("token_win_ratio") > 0.3)
      & (F.col("distinct_tokens") > 3), "pnl_percent", 20),
      _SOL_TOP + """\nFINAL SELECT * FROM full_top WHERE pnl_percent > -50 AND token_win_ratio > 0.3 AND distinct_tokens > 3
      ORDER BY pnl_percent DESC NULLS LAST, account LIMIT 20""", _SD, _RL)
_smart = lambda t: TR.smart_traders(_top_sol(t), 25, 0.4)
_SMART = _SOL_TOP + """, smart AS (SELECT account FROM full_top WHERE pnl_percent > 0 AND token_win_ratio > 0.4
  ORDER BY pnl_percent DESC, account LIMIT 25)"""
check("a25_smart_traders", _smart, _SMART + "\nFINAL SELECT account FROM smart")
_FLOW = """SELECT token_a AS token, pool_address AS pool, date_trunc('hour', timestamp) AS minute_ts,
  sum(if(amount_a > 0, abs(amount_a * token_a_usdc_price), 0)) AS smart_buy_volume,
  sum(if(amount_a < 0, abs(amount_a * token_a_usdc_price), 0)) AS smart_sell_volume,
  count(*) FILTER (amount_a > 0) AS smart_buy_count, count(*) FILTER (amount_a < 0) AS smart_sell_count
  FROM swaps WHERE account IN (SELECT account FROM smart) GROUP BY 1, 2, 3"""
check("a26_smart_flows", lambda t: TR.smart_flows(t.swaps, _smart(t), interval="1 hour"),
      _SMART + "\nFINAL " + _FLOW, "smart_buy_volume smart_sell_volume")
check("j16_smart_money_trades", lambda t: TR.smart_money_trades(t.swaps, _smart(t)).select("block_number", "account"),
      _SMART + "\nFINAL SELECT block_number, account FROM swaps WHERE account IN (SELECT account FROM smart)")
_OFLOW = """SELECT token_a AS token, pool_address AS pool, date_trunc('{u}', timestamp) AS minute_ts,
  sum(if(amount_a > 0, abs(amount_b * token_b_usdc_price), 0)) AS buy_volume_usdc,
  sum(if(amount_a < 0, abs(amount_b * token_b_usdc_price), 0)) AS sell_volume_usdc,
  count(*) FILTER (amount_a > 0) AS buy_count, count(*) FILTER (amount_a < 0) AS sell_count,
  avg(abs(slippage_pct)) AS avg_slippage, quantile_cont(abs(slippage_pct), 0.8) AS p80_slippage,
  avg(pool_tvl) AS avg_tvl FROM tvl GROUP BY 1, 2, 3"""
_OD = "buy_volume_usdc sell_volume_usdc avg_slippage p80_slippage avg_tvl"
check("a27_order_flow", lambda t: TR.order_flow(t.swaps, interval="1 day"), _OFLOW.format(u="day"), _OD)

# --- movers and tokens -----------------------------------------------------------------------
_MOV = f"""mv AS (SELECT date_trunc('day', timestamp) AS day, token_a AS token_address, pool_address, min(token_a_symbol) AS token_symbol,
  min(token_a_creation_date) AS token_created_at, min(dex) AS dex, arg_min(token_a_usdc_price, {KEY}) AS open_price_usdc,
  arg_max(token_a_usdc_price, {KEY}) AS close_price_usdc, sum(abs(amount_b * token_b_usdc_price) * sign) AS volume_usdc,
  min({KEY}) AS k0, max({KEY}) AS k1 FROM xs WHERE token_a_usdc_price > 0 AND token_b IN {Q_SQL} AND slippage_pct < 10
  AND abs(amount_b * token_b_usdc_price) >= 0.01 GROUP BY 1, 2, 3)"""
_movers = lambda t: MV.daily_movers(t.xs, QUOTES)
check("a16_daily_movers", lambda t: _drop(_movers(t)), f"WITH {_MOV}\nFINAL SELECT * EXCLUDE (k0, k1) FROM mv",
      "open_price_usdc close_price_usdc volume_usdc")
_B2 = _BEST.replace(f"'{START}' AND '{END}'", "TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-27'")
_TM = f"""WITH {_STATS}, {_B2}, {_MOV}, tm AS (SELECT TIMESTAMP '2024-01-20' AS start_date, TIMESTAMP '2024-01-27' AS end_date, token_address,
  mv.pool_address, min(mv.dex) AS dex, min(token_symbol) AS token_symbol,
  CAST(epoch(TIMESTAMP '{NOW}') - epoch(min(token_created_at)) AS BIGINT) AS age_sec, sum(volume_usdc) AS volume_usdc,
  arg_min(open_price_usdc, k0) AS open_price_usdc, arg_max(close_price_usdc, k1) AS close_price_usdc
  FROM mv JOIN best ON best.token_a = mv.token_address AND best.pool_address = mv.pool_address
  WHERE day BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-27' GROUP BY ALL)"""
_tm = lambda t: MV.top_movers(_movers(t), _stats(t), now(), 1, 7)
_TMD = "volume_usdc open_price_usdc close_price_usdc grow_pct"
check("a17_top_movers", _tm, _TM + "\nFINAL SELECT *, (close_price_usdc - open_price_usdc) / open_price_usdc * 100 AS grow_pct FROM tm", _TMD)
check("o3_top_movers_k", lambda t: TR.top_k(_tm(t), (F.col("volume_usdc") > 100) & (F.col("age_sec") > 30 * 86400),
      "grow_pct", 20, tie="token_address"),
      _TM + """\nFINAL SELECT *, (close_price_usdc - open_price_usdc) / open_price_usdc * 100 AS grow_pct FROM tm
      WHERE volume_usdc > 100 AND age_sec > 30 * 86400 ORDER BY grow_pct DESC LIMIT 20""", _TMD)
check("a18_tokens_by_creation", lambda t: MV.tokens_by_creation(t.xs),
      "SELECT token_a AS token_address, min(token_a_symbol) AS token_symbol, min(token_a_creation_date) AS creation_date, min(timestamp) AS first_swap_date FROM xs GROUP BY 1")

# --- collapse, replace, sets, ordering --------------------------------------------------------
check("a22_collapse", lambda t: D.collapse(
      t.swaps.select("block_number", "account", "sign").unionByName(
          t.swaps.filter("block_number % 3 = 0").select("block_number", "account", F.lit(-1).alias("sign"))), ["block_number"]),
      "SELECT block_number, account, sign FROM swaps WHERE block_number % 3 <> 0", "", "sign")
check("a23_replace_latest", lambda t: D.replace_latest(
      t.swaps.select("account", "token_a", "timestamp", "amount_a"), ["account"], ["timestamp", "token_a"]),
      """SELECT account, token_a, timestamp, amount_a FROM (SELECT *, row_number() OVER (PARTITION BY account
      ORDER BY timestamp DESC, token_a DESC) AS rn FROM swaps) WHERE rn = 1""", "amount_a")
check("a24_sum_merge", lambda t: D.sum_merge(t.swaps.select("token_a", "amount_a", "amount_b"), ["token_a"], ["amount_a", "amount_b"]),
      "SELECT token_a, sum(amount_a) AS amount_a, sum(amount_b) AS amount_b FROM swaps GROUP BY 1", "amount_a amount_b")
check("u1_both_tokens", lambda t: C.both_tokens(t.swaps).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
      "SELECT token, count(*) AS n FROM (SELECT token_a AS token FROM swaps UNION ALL SELECT token_b FROM swaps) GROUP BY 1")
check("u3_distinct_keys", lambda t: D.distinct_keys(t.swaps, "account", "pool_address"), "SELECT DISTINCT account, pool_address FROM swaps")
check("u4_insert_ignore", lambda t: D.insert_ignore(
      t.swaps.filter("amount_a < 0").groupBy("account").agg(F.min("block_number").alias("block_number")),
      t.swaps.select("account", "block_number"), ["account"], ["block_number"]),
      """WITH d AS (SELECT account, min(block_number) AS block_number FROM swaps WHERE amount_a < 0 GROUP BY 1)
FINAL SELECT * FROM d UNION ALL SELECT account, min(block_number) FROM swaps WHERE
      account NOT IN (SELECT account FROM d) GROUP BY 1""")
check("o1_order_key", lambda t: t.swaps.groupBy("pool_address").agg(
      F.max_by("block_number", OK.order_key()).alias("last_struct"), F.max_by("block_number", OK.packed_order_key()).alias("last_packed")),
      f"SELECT pool_address, arg_max(block_number, {KEY}) AS last_struct, arg_max(block_number, {KEY}) AS last_packed FROM swaps GROUP BY 1")
check("o4_last_n", lambda t: O.last_n(t.swaps.select("pool_address", "block_number", "timestamp"), ["pool_address"], ["timestamp", "block_number"], 10),
      """SELECT pool_address, block_number, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY pool_address
      ORDER BY timestamp DESC, block_number DESC) AS rn FROM swaps) WHERE rn <= 10""")
check("o5_latest_before", lambda t: PR.latest_before(t.swaps, END, ["token_a"], ["block_number", "pool_address"]),
      f"""SELECT token_a, block_number, pool_address FROM (SELECT *, row_number() OVER (PARTITION BY token_a
      ORDER BY timestamp DESC, transaction_index DESC, log_index DESC) AS rn FROM swaps WHERE timestamp <= '{END}') WHERE rn = 1""")
check("o6_sample_distinct", lambda t: D.sample_distinct(t.swaps, "account", 10), "SELECT DISTINCT account FROM swaps ORDER BY 1 LIMIT 10")
check("o7_downsample", lambda t: O.downsample(t.swaps.select("block_number", "timestamp", F.when(
      F.col("block_number") % 11 > 0, F.col("token_a_usdc_price")).alias("price")), 6, ["timestamp", "block_number"], ["price"]),
      """SELECT block_number, timestamp, token_a_usdc_price AS price FROM (SELECT *, row_number() OVER (ORDER BY timestamp, block_number) AS rn
      FROM swaps WHERE block_number % 11 > 0) WHERE rn % 6 = 1""", "price")
check("o8_max_by", lambda t: t.swaps.groupBy("token_a").agg(F.max_by(
      "block_number", F.struct(F.abs(F.col("amount_a")), "block_number")).alias("block_number")),
      "SELECT token_a, arg_max(block_number, {'a': abs(amount_a), 'b': block_number}) AS block_number FROM swaps GROUP BY 1")
check("w2_cumulative", lambda t: O.cumulative(C.swaps_per_bucket(t.swaps, "1 hour"), "swap_count", ["token"], ["bucket_ts"]),
      """SELECT *, sum(swap_count) OVER (PARTITION BY token ORDER BY bucket_ts) AS total FROM (SELECT token_a AS token,
      date_trunc('hour', timestamp) AS bucket_ts, count(*) AS swap_count FROM swaps GROUP BY 1, 2)""", "", "total")
check("j8_asof_join", lambda t: O.asof_join(
      t.swaps.select("token_a", "timestamp", "block_number"),
      t.swaps.filter("block_number % 5 = 0").select("token_a", "timestamp", F.col("block_number").alias("seen")),
      ["timestamp"], ["token_a"], ["seen"]),
      """WITH r AS (SELECT token_a, timestamp, block_number AS seen FROM swaps WHERE block_number % 5 = 0)
FINAL SELECT s.token_a, s.timestamp, s.block_number, r.seen FROM swaps s ASOF LEFT JOIN r ON r.token_a = s.token_a AND r.timestamp < s.timestamp""")
check("t11_rollback", lambda t: P.block_range(D.rollback(t.swaps, END), 0, 10 ** 12).select("block_number"),
      f"SELECT block_number FROM swaps WHERE timestamp <= TIMESTAMP '{END}'")
check("t11_retractions", lambda t: D.collapse(t.swaps.unionByName(D.retractions(t.swaps, END)).select(
      "block_number", "account", "sign"), ["block_number"]).drop("sign"),
      f"SELECT block_number, account FROM swaps WHERE timestamp <= TIMESTAMP '{END}'")
check("j17_one_row_cross", lambda t: t.swaps.agg(F.max("timestamp").alias("last_ts")).crossJoin(
      t.swaps.agg(F.avg(M.pool_tvl()).alias("avg_tvl"))),
      "SELECT (SELECT max(timestamp) FROM swaps) AS last_ts, (SELECT avg(pool_tvl) FROM tvl) AS avg_tvl", "avg_tvl")

# --- scalar functions ----------------------------------------------------------------------------
check("f1_buckets", lambda t: t.swaps.select("block_number", *[TM.bucket(F.col("timestamp"), w).alias(n) for w, n in (
      ("1 minute", "m1"), ("1 hour", "h1"), ("1 day", "d1"), ("5 minutes", "m5"), ("10 seconds", "s10"))],
      TM.yyyymm(F.col("timestamp")).alias("ym")),
      """SELECT block_number, date_trunc('minute', timestamp) AS m1, date_trunc('hour', timestamp) AS h1,
      CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS d1, time_bucket(INTERVAL 5 MINUTE, timestamp, TIMESTAMP '1970-01-01') AS m5,
      time_bucket(INTERVAL 10 SECOND, timestamp, TIMESTAMP '1970-01-01') AS s10, year(timestamp) * 100 + month(timestamp) AS ym FROM swaps""", "", "ym")
check("f2_prev_hour", lambda t: t.swaps.select("block_number", TM.prev_hour(F.col("timestamp")).alias("h")),
      "SELECT block_number, date_trunc('hour', timestamp - INTERVAL 1 HOUR) AS h FROM swaps")
check("f3_unix", lambda t: t.swaps.select("block_number", TM.to_unix(F.col("timestamp")).alias("s"),
      TM.from_unix(TM.to_unix(F.col("timestamp"))).alias("ts")),
      "SELECT block_number, CAST(epoch(date_trunc('second', timestamp)) AS BIGINT) AS s, date_trunc('second', timestamp) AS ts FROM swaps")
check("f4_math", lambda t: t.swaps.select("block_number", F.abs("amount_b").alias("a"), F.ln("token_a_usdc_price").alias("l"),
      F.pow("token_a_usdc_price", F.lit(3)).alias("p"), (F.col("amount_b") / F.col("amount_a")).alias("d")),
      "SELECT block_number, abs(amount_b) AS a, ln(token_a_usdc_price) AS l, pow(token_a_usdc_price, 3) AS p, amount_b / amount_a AS d FROM swaps", "a l p d")
check("f5_conditionals", lambda t: t.swaps.select("block_number", F.when(F.col("amount_a") > 0, "buy").otherwise("sell").alias("side"),
      F.nullif(F.col("log_index"), F.lit(0)).alias("n"), F.lower("token_a").alias("low"), F.col("log_index").between(2, 4).alias("mid"),
      F.col("dex").isin("orca", "raydium").alias("known")),
      """SELECT block_number, CASE WHEN amount_a > 0 THEN 'buy' ELSE 'sell' END AS side, nullif(log_index, 0) AS n, lower(token_a) AS low,
      log_index BETWEEN 2 AND 4 AS mid, dex IN ('orca', 'raydium') AS known FROM swaps""", "", "n")
check("f6_safe_div", lambda t: t.swaps.select("block_number", N.safe_div(F.col("amount_a"), F.col("log_index")).alias("q")),
      "SELECT block_number, amount_a / nullif(log_index, 0) AS q FROM swaps", "q")
check("f7_ago", lambda t: t.swaps.filter(F.col("timestamp") >= TM.ago(now(), 36, "hour")).select("block_number"),
      f"SELECT block_number FROM swaps WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 36 HOUR")
check("f8_boundary_diff", lambda t: t.swaps.select("block_number", TM.boundary_diff("hour", F.col("timestamp"), now()).alias("h"),
      TM.boundary_diff("day", F.col("timestamp"), now()).alias("d")),
      f"SELECT block_number, date_diff('hour', timestamp, TIMESTAMP '{NOW}') AS h, date_diff('day', timestamp, TIMESTAMP '{NOW}') AS d FROM swaps")
check("f15_pair_price", lambda t: t.swaps.select("block_number", N.pair_price(F.col("amount_a"), F.col("amount_b")).alias("p")),
      "SELECT block_number, abs(amount_b / amount_a) AS p FROM swaps", "p")
check("f16_reserve_price", lambda t: t.swaps.select("block_number", N.reserve_price(F.col("pool_token_a_reserve"), F.col("pool_token_b_reserve")).alias("p")),
      "SELECT block_number, pool_token_a_reserve / pool_token_b_reserve AS p FROM swaps", "p")
check("f17_decimal_string", lambda t: t.swaps.select("block_number", N.decimal_string(
      (F.col("block_number") - 50) * 37, F.col("log_index")).alias("txt")),
      """WITH v AS (SELECT block_number, (block_number - 50) * 37 AS x, log_index AS d FROM swaps),
w AS (SELECT *, CASE WHEN x < 0 THEN '-' ELSE '' END AS sg, CAST(abs(x) AS VARCHAR) AS dg FROM v)
FINAL SELECT block_number, CASE WHEN d = 0 THEN CAST(x AS VARCHAR) WHEN length(dg) <= d THEN sg || '0.' || lpad(dg, d, '0')
      ELSE sg || dg[:length(dg) - d] || '.' || dg[length(dg) - d + 1:] END AS txt FROM w""")
_FEE = "CASE dex WHEN 'raydium' THEN 0.0025 WHEN 'orca' THEN 0.003 WHEN 'uniswap_v3' THEN 0.0005 ELSE 0.003 END"
check("f20_dex_fee", lambda t: t.swaps.select("block_number", M.dex_fee(F.col("dex")).alias("fee")),
      f"SELECT block_number, {_FEE} AS fee FROM swaps", "fee")
_AGE, _TVLX = "(block_number % 500)", "(block_number % 37) * 400000.0"
_BUCKET = """CASE WHEN a BETWEEN 0 AND 7 AND v BETWEEN 0 AND 100000 THEN 'new_tokens' WHEN a BETWEEN 7 AND 30 AND v BETWEEN 100000 AND 1000000
  THEN 'emerging' WHEN a BETWEEN 30 AND 365 AND v BETWEEN 1000000 AND 10000000 THEN 'established'
  WHEN a BETWEEN 365 AND 9999 AND v >= 10000000 THEN 'blue_chip' ELSE 'new_tokens' END"""
check("f21_bucket_of", lambda t: t.swaps.select("block_number", M.bucket_of(F.expr(_AGE), F.expr(f"CAST({_TVLX} AS DOUBLE)")).alias("bucket")),
      f"SELECT block_number, {_BUCKET} AS bucket FROM (SELECT block_number, {_AGE} AS a, {_TVLX} AS v FROM swaps)")
check("f22_net_return", lambda t: t.swaps.select("block_number", N.net_return(
      F.col("token_a_usdc_price"), F.lit(1.2), M.dex_fee(F.col("dex")), F.lit(0.01)).alias("r")),
      f"SELECT block_number, token_a_usdc_price / 1.2 * (1 - {_FEE} - 0.01) - 1 AS r FROM swaps", "r")
check("x1_allowed_quote_tokens", lambda t: RB.with_quote_function(t.spark, QUOTES).sql(
      "SELECT block_number, token_b FROM {s} WHERE array_contains(allowed_quote_tokens(), token_b)", s=t.swaps),
      f"SELECT block_number, token_b FROM swaps WHERE token_b IN {Q_SQL}")
check("x4_dispatch", lambda t: D.dispatch(t.swaps, [
      (F.col("dex") == "orca", [F.col("block_number"), F.lit("one").alias("kind")]),
      (F.col("amount_a") > 0, [F.col("block_number"), F.lit("two").alias("kind")])]),
      "SELECT block_number, CASE WHEN dex = 'orca' THEN 'one' ELSE 'two' END AS kind FROM swaps WHERE dex = 'orca' OR amount_a > 0")
