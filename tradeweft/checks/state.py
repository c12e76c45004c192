"""Checks of positions, prices, holders, issuance and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeweft.checks.base import END, Q_SQL, QUOTES, check
from tradeweft.constants import ZERO_ADDRESS
from tradeweft.functions.num import pair_price
from tradeweft.operators import holders as H
from tradeweft.operators import positions as PO
from tradeweft.operators import pricing as PR
from tradeweft.operators import tokens as TK
from tradeweft.operators.dedup import replace_latest
from tradeweft.operators.filters import block_range
from tradeweft.sources import fixture as X
from tradeweft.sources.tables import holders_rows
from tradeweft.session import written_table

# --- positions ------------------------------------------------------------------------------
# Lots and sells as intervals of units; every overlap is what a sell takes from a lot.
_FIFO = """legs AS ({legs}),
r AS (SELECT *, sum(if(buy, q, 0)) OVER w AS b, sum(if(buy, 0, q)) OVER w AS s FROM legs
      WINDOW w AS (PARTITION BY account, token ORDER BY n)),
e AS (SELECT *, s - greatest(0, max(s - b) OVER (PARTITION BY account, token ORDER BY n)) AS e1,
      s - if(buy, 0, q) - greatest(0, coalesce(max(s - b) OVER (PARTITION BY account, token ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e0 FROM r),
ov AS (SELECT l.account, l.token, l.n AS lot, x.n AS sell, least(l.b, x.e1) - greatest(l.b - l.q, x.e0) AS u, l.p AS lp, x.p AS sp
      FROM e l JOIN e x ON l.account = x.account AND l.token = x.token AND l.buy AND NOT x.buy AND x.e1 > x.e0
        AND l.b - l.q < x.e1 AND x.e0 < l.b),
per_sell AS (SELECT account, token, sell, sum(u * lp) AS cost, sum(u * (sp - lp)) AS profit FROM ov GROUP BY ALL),
per_lot AS (SELECT o.account, o.token, o.lot, max(sell) AS closer, sum(u) AS used, sum(u * (sp - lp)) AS pnl FROM ov o GROUP BY ALL),
closed AS (SELECT p.account, p.token, closer AS n, count(*) FILTER (pnl > 0) AS w, count(*) FILTER (pnl <= 0) AS l
      FROM per_lot p JOIN e ON e.account = p.account AND e.token = p.token AND e.n = p.lot AND e.q = p.used GROUP BY ALL),
fifo AS (SELECT e.account, e.token, e.n, b - e1 AS balance, coalesce(cost, 0) AS cost, coalesce(profit, 0) AS profit,
      coalesce(sum(w) OVER ww, 0) AS wins, coalesce(sum(l) OVER ww, 0) AS losses
      FROM e LEFT JOIN per_sell ps ON ps.account = e.account AND ps.token = e.token AND ps.sell = e.n
      LEFT JOIN closed c ON c.account = e.account AND c.token = e.token AND c.n = e.n
      WINDOW ww AS (PARTITION BY e.account, e.token ORDER BY e.n))"""
_ONE = """SELECT account, token_a AS token, block_number AS n, amount_a > 0 AS buy,
  CAST(abs(amount_a) AS DECIMAL(18,6)) AS q, CAST(token_a_usdc_price AS DECIMAL(18,6)) AS p FROM swaps"""
_TWO = _ONE.replace("amount_a > 0", "amount_a < 0").replace("swaps", "evm") + """ UNION ALL
  SELECT account, token_b, block_number, amount_a > 0, CAST(abs(amount_b) AS DECIMAL(18,6)), CAST(token_b_usdc_price AS DECIMAL(18,6)) FROM evm"""
_BLOCK = ["block_number"]


def _one_leg(t):
    return PO.position_legs(t.swaps, 1, False, _BLOCK)


check("t1_fifo_positions", lambda t: PO.fifo_positions(_one_leg(t), order=_BLOCK).select(
      "account", "token", "block_number", "balance", "cost", "profit", "wins", "losses"),
      f"WITH {_FIFO.format(legs=_ONE)}\nFINAL SELECT account, token, n AS block_number, balance, cost, profit, wins, losses FROM fifo",
      "balance cost profit", "wins losses")
check("t1_fifo_both_sides", lambda t: PO.fifo_positions(
      PO.position_legs(t.evm, -1, True, _BLOCK), order=_BLOCK, eps=1e-10).select(
      "account", "token", "block_number", "balance", "cost", "profit", "wins", "losses"),
      f"WITH {_FIFO.format(legs=_TWO)}\nFINAL SELECT account, token, n AS block_number, balance, cost, profit, wins, losses FROM fifo",
      "balance cost profit", "wins losses")
# The same histories with units of every size: 10^27 units of one token, 10^-18 of the next, as they are for the rest.


def _wide_and_dust(t):
    power = F.when(F.col("token") == "T1", 27).when(F.col("token") == "T2", -18).otherwise(0)
    size = F.pow(F.lit(10.0), power)

    def moved(value, by):  # the point is moved in the text, so that the digits stay as they are
        return F.concat(F.col(value).cast("decimal(18,6)").cast("string"), F.lit("E"), by.cast("string")).cast("double")

    legs = _one_leg(t).withColumns({"amount": moved("amount", power), "price": moved("price", -power)})
    return PO.fifo_positions(legs, order=_BLOCK).select(
        "account", "token", "block_number", (F.col("balance") / size).alias("balance"), "cost", "profit", "wins", "losses")


check("t1_wide_and_dust", _wide_and_dust,
      f"WITH {_FIFO.format(legs=_ONE)}\nFINAL SELECT account, token, n AS block_number, balance, cost, profit, wins, losses FROM fifo",
      "balance cost profit", "wins losses")
_XC = ["balance", "cost_usdc", "profit_usdc", "wins", "loses"]
check("t2_extend_positions", lambda t: PO.extend_positions(
      t.swaps.select("account", "block_number", "token_a", "token_b", "amount_a", "amount_b", "token_a_usdc_price", "token_b_usdc_price"),
      order=_BLOCK, eligible=F.col("token_b").isin(QUOTES)).select("block_number", *[f"token_a_{c}" for c in _XC], "token_b_balance"),
      f"""WITH {_FIFO.format(legs=_ONE + f" WHERE token_b IN {Q_SQL}")}
FINAL SELECT block_number, coalesce(balance, 0) AS token_a_balance, coalesce(cost, 0) AS token_a_cost_usdc, coalesce(profit, 0) AS token_a_profit_usdc,
      coalesce(wins, 0) AS token_a_wins, coalesce(losses, 0) AS token_a_loses, 0.0 AS token_b_balance FROM swaps LEFT JOIN fifo ON n = block_number""",
      "token_a_balance token_a_cost_usdc token_a_profit_usdc token_b_balance", "token_a_wins token_a_loses")
check("t15_open_lots", lambda t: PO.open_lots(_one_leg(t), order=_BLOCK).groupBy("account", "token").agg(
      F.count_if(F.col("amount") > 0).alias("lots"), F.sum("amount").alias("balance"),
      F.sum(F.col("amount") * F.col("price")).alias("cost"), F.max("wins").alias("wins"), F.max("losses").alias("losses")),
      f"""WITH {_FIFO.format(legs=_ONE)}, z AS (SELECT account, token, max(e1) AS sold FROM e GROUP BY 1, 2)
FINAL SELECT e.account, e.token, count(*) FILTER (buy AND b > sold) AS lots,
      sum(if(buy AND b > sold, b - greatest(b - q, sold), 0)) AS balance, sum(if(buy AND b > sold, (b - greatest(b - q, sold)) * p, 0)) AS cost,
      max(wins) AS wins, max(losses) AS losses FROM e JOIN z ON z.account = e.account AND z.token = e.token
      JOIN fifo ON fifo.account = e.account AND fifo.token = e.token AND fifo.n = e.n GROUP BY 1, 2""", "balance cost", "wins losses")
check("t15_restart", lambda t: PO.fifo_positions(
      _one_leg(t).filter("block_number >= 4000"), order=_BLOCK,
      opening=PO.open_lots(_one_leg(t).filter("block_number < 4000"), order=_BLOCK)).select(
      "account", "token", "block_number", "balance", "cost", "profit", "wins", "losses"),
      f"WITH {_FIFO.format(legs=_ONE)}\nFINAL SELECT account, token, n AS block_number, balance, cost, profit, wins, losses FROM fifo WHERE n >= 4000",
      "balance cost profit", "wins losses")

# --- prices ------------------------------------------------------------------------------------
_MEDIAN = """SELECT token_a AS token, block_number, token_a_usdc_price AS price,
  if(count(*) OVER w = 10, median(token_a_usdc_price) OVER w, NULL) AS ref_price FROM swaps
  WINDOW w AS (PARTITION BY token_a ORDER BY block_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
check("w12_ref_price_median", lambda t: PR.ref_price_median(
      t.swaps.select(F.col("token_a").alias("token"), "block_number", F.col("token_a_usdc_price").alias("price")), order=_BLOCK),
      _MEDIAN, "price ref_price")

_REFS = [("USDC", "none"), ("SOL", "pool_0"), ("T2", "pool_2")]


def _evm_unpriced(t):
    return t.sql("""SELECT block_number, pool_address, amount_a, amount_b, token_a,
        CASE WHEN token_b = 'OTHER' AND token_a <> 'T2' THEN 'T2' ELSE token_b END AS token_b FROM {e}""", e=t.evm)


_PM = """SELECT token_a AS token, n, if(count(*) OVER w = 10, median(pa) OVER w, NULL) AS m FROM {src}
  WINDOW w AS (PARTITION BY token_a ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
T8_CTE = f"""u AS (SELECT block_number AS n, timestamp, account, pool_address, amount_a, amount_b, token_a,
        CASE WHEN token_b = 'OTHER' AND token_a <> 'T2' THEN 'T2' ELSE token_b END AS token_b FROM evm),
o AS (SELECT *, coalesce(list_position(['USDC','SOL','T2'], token_a), 99) < coalesce(list_position(['USDC','SOL','T2'], token_b), 99) AS sw FROM u),
v AS (SELECT n, timestamp, account, pool_address, sw, if(sw, amount_b, amount_a) AS amount_a, if(sw, amount_a, amount_b) AS amount_b, if(sw, token_b, token_a) AS token_a, if(sw, token_a, token_b) AS token_b,
        abs(if(sw, amount_a, amount_b)) / abs(if(sw, amount_b, amount_a)) AS ratio, abs(if(sw, amount_a, amount_b)) AS qb FROM o),
f AS (SELECT * FROM v WHERE token_b IN ('USDC','SOL','T2') AND (token_b <> 'USDC' OR qb BETWEEN 0.1 AND 10000)),
u1 AS (SELECT token_a, n, ratio AS pa FROM f WHERE token_a = 'SOL' AND pool_address = 'pool_0' AND token_b = 'USDC'),
m1 AS ({_PM.format(src='u1')}),
u2 AS (SELECT f.token_a, f.n, f.ratio * m1.m AS pa FROM f ASOF JOIN m1 ON m1.token = f.token_b AND m1.n < f.n
        WHERE f.token_a = 'T2' AND f.pool_address = 'pool_2' AND m1.m IS NOT NULL),
m2 AS ({_PM.format(src='u2')}), m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
p AS (SELECT f.n, if(token_b = 'USDC', 1.0, m.m) AS pb, ratio FROM f ASOF LEFT JOIN m ON m.token = f.token_b AND m.n < f.n)"""
_T8_SQL = f"""WITH {T8_CTE}
FINAL SELECT v.n AS block_number, token_a, token_b, coalesce(p.ratio * pb, 0) * 100 AS token_a_usdc_price_x100, coalesce(pb, 0) AS token_b_usdc_price,
        sw AS a_b_swapped FROM v LEFT JOIN p ON p.n = v.n"""
_t8 = lambda df: df.select(
    "block_number", "token_a", "token_b", (F.col("token_a_usdc_price") * 100).alias("token_a_usdc_price_x100"), "token_b_usdc_price", "a_b_swapped")
check("t8_price_evm", lambda t: _t8(PR.price_evm(_evm_unpriced(t), _REFS, "USDC", order=_BLOCK)), _T8_SQL, "token_a_usdc_price_x100 token_b_usdc_price")

def _t8_resumed(t):
    """Three runs, each from the last prices that the runs before it have left."""
    rows, parts, history = _evm_unpriced(t), [], None
    last = rows.agg(F.max("block_number")).first()[0]
    for lo, hi in ((0, last // 4), (last // 4, last // 2), (last // 2, last + 1)):
        piece = rows.filter((F.col("block_number") >= lo) & (F.col("block_number") < hi))
        priced = written_table(PR.price_evm(piece, _REFS, "USDC", order=_BLOCK, history=history), "priced")
        history = written_table(PR.reference_history(priced, _REFS, order=_BLOCK, history=history), "history")
        parts.append(_t8(priced))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


check("t8_resume", _t8_resumed, _T8_SQL, "token_a_usdc_price_x100 token_b_usdc_price")
_UPD = """SELECT q.token_a AS token, q.n, q.pa AS price, q.pool_address AS pool, best.pool_address IS NOT NULL AS best
  FROM ({src}) q LEFT JOIN ({best}) best ON best.token_a = q.token_a AND best.h = date_trunc('hour', q.ts - INTERVAL 1 HOUR)
  WHERE (best.pool_address IS NULL OR best.pool_address = q.pool_address) AND q.pa IS NOT NULL"""
_RB = """SELECT token_a, h, pool_address FROM (SELECT w.token_a, w.h, s.pool_address, row_number() OVER (PARTITION BY w.token_a, w.h
    ORDER BY sum(s.v) DESC, s.pool_address) AS rn FROM (SELECT DISTINCT token_a, date_trunc('hour', ts - INTERVAL 1 HOUR) AS h FROM ({src})) w
  JOIN (SELECT token_a, pool_address, date_trunc('hour', ts) AS h, sum(abs(amount_b * pb)) AS v FROM ({src}) GROUP BY 1, 2, 3) s
    ON s.token_a = w.token_a AND s.h BETWEEN w.h - INTERVAL 3 DAY AND w.h GROUP BY 1, 2, 3) WHERE rn = 1"""
_Q1 = "SELECT * FROM st WHERE token_a = 'SOL'"
_Q2 = "SELECT * FROM quoted WHERE token_a <> 'SOL'"


def _unpriced(t):
    return t.sql("""SELECT block_number, timestamp, pool_address, amount_a, amount_b, token_a,
        CASE WHEN block_number % 50 = 7 THEN 'T2' ELSE token_b END AS token_b FROM {e}""", e=t.swaps)


_T9_SQL = f"""WITH u AS (SELECT block_number AS n, timestamp AS ts, pool_address, amount_a, amount_b, token_a,
        CASE WHEN block_number % 50 = 7 THEN 'T2' ELSE token_b END AS token_b, abs(amount_b / amount_a) AS ratio FROM swaps),
st AS (SELECT *, 1.0 AS pb, ratio AS pa FROM u WHERE token_b IN ('USDC', 'USDT')),
native AS ({_UPD.format(src=_Q1, best=_RB.format(src=_Q1))}),
bn AS (SELECT u.*, native.price AS pb, u.ratio * native.price AS pa FROM u ASOF LEFT JOIN native ON native.token = u.token_b AND native.n < u.n
        WHERE token_b = 'SOL'),
quoted AS (SELECT * FROM st UNION ALL SELECT * FROM bn),
moves AS (SELECT * FROM native UNION ALL {_UPD.format(src=_Q2, best=_RB.format(src=_Q2))}),
ob AS (SELECT u.*, moves.price AS pb FROM u ASOF LEFT JOIN moves ON moves.token = u.token_b AND moves.n < u.n WHERE token_b NOT IN {Q_SQL}),
rest AS (SELECT n, token_a, pb FROM ob UNION ALL SELECT n, token_a, pb FROM quoted WHERE pa IS NULL),
ra AS (SELECT rest.n, moves.price AS pa, rest.pb, moves.pool, moves.best FROM rest ASOF LEFT JOIN moves ON moves.token = rest.token_a AND moves.n < rest.n)
FINAL SELECT n AS block_number, coalesce(pa, 0) * 10 AS token_a_usdc_price_x10, coalesce(pb, 0) AS token_b_usdc_price, '' AS token_a_pricing_pool,
        false AS token_a_best_pricing_pool_selected FROM quoted WHERE pa IS NOT NULL
      UNION ALL SELECT n, coalesce(pa, 0) * 10, coalesce(pb, 0), coalesce(pool, ''), coalesce(best, false) FROM ra"""
_t9 = lambda df: df.select(
    "block_number", (F.col("token_a_usdc_price") * 10).alias("token_a_usdc_price_x10"), "token_b_usdc_price", "token_a_pricing_pool", "token_a_best_pricing_pool_selected")
check("t9_price_quote", lambda t: _t9(PR.price_quote(_unpriced(t), ["USDC", "USDT", "SOL"], X.STABLES, order=["block_number"], days=3)), _T9_SQL,
      "token_a_usdc_price_x10 token_b_usdc_price")

def _t9_resumed(t):
    """Three runs cut at full hours, each from stored prices and volumes."""
    rows, parts, state = _unpriced(t), [], None
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    cuts = [c.replace(minute=0, second=0, microsecond=0) for c in cuts]
    for lo, hi in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        piece = rows if lo is None else rows.filter(F.col("timestamp") >= F.lit(lo))
        piece = piece if hi is None else piece.filter(F.col("timestamp") < F.lit(hi))
        priced, after = PR.price_quote_from(piece, state, ["USDC", "USDT", "SOL"], X.STABLES, ["block_number"], 3)
        parts.append(_t9(written_table(priced, "priced")))
        state = {name: written_table(df, f"state-{name}") for name, df in after.items()}
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


check("t9_resume", _t9_resumed, _T9_SQL, "token_a_usdc_price_x10 token_b_usdc_price")
check("p21_pair_price_series", lambda t: t.swaps.groupBy("pool_address").agg(
      F.avg(pair_price(F.col("amount_a"), F.col("amount_b"))).alias("mean_price")),
      "SELECT pool_address, avg(abs(amount_b / amount_a)) AS mean_price FROM swaps GROUP BY 1", "mean_price")

# --- holders ---------------------------------------------------------------------------------------
_HOLD = f"""lg AS (SELECT token, timestamp, transaction_index AS tx, log_index AS li, from_address AS a, -amount AS d, 0 AS leg FROM transfers
    WHERE from_address <> '{ZERO_ADDRESS}' UNION ALL SELECT token, timestamp, transaction_index, log_index, to_address, amount, 1 FROM transfers),
bal AS (SELECT *, sum(d) OVER (PARTITION BY token, a ORDER BY timestamp, tx, li, leg) AS bal FROM lg),
ch AS (SELECT token, timestamp, tx, li, sum(CASE WHEN leg = 0 AND bal = 0 THEN -1 WHEN leg = 1 AND bal = d AND bal > 0 THEN 1 ELSE 0 END) AS c
    FROM bal GROUP BY ALL),
hc AS (SELECT token, timestamp, tx AS transaction_index, li AS log_index,
    CAST(sum(c) OVER (PARTITION BY token ORDER BY timestamp, tx, li) AS BIGINT) AS holders FROM ch)"""
_counts = lambda t: H.holder_counts(t.transfers, strict=False)
check("w16_holder_deltas", lambda t: H.holder_deltas(t.transfers).groupBy("token").agg(F.sum("change").alias("holders"), F.count(F.lit(1)).alias("legs")),
      f"WITH {_HOLD}\nFINAL SELECT token, sum(CASE WHEN leg = 0 AND bal = 0 THEN -1 WHEN leg = 1 AND bal = d AND bal > 0 THEN 1 ELSE 0 END) AS holders, count(*) AS legs FROM bal GROUP BY 1",
      "", "holders")
check("t3_holder_counts", _counts, f"WITH {_HOLD}\nFINAL SELECT * FROM hc", "", "log_index")
check("t3_holder_counts_strict", lambda t: H.holder_counts(t.transfers), f"WITH {_HOLD}\nFINAL SELECT * FROM hc", "", "log_index")
_poor = lambda t: t.transfers.withColumn("amount", F.when(
    F.col("from_address") == ZERO_ADDRESS, (F.col("amount") / 3).cast("decimal(38,0)")).otherwise(F.col("amount")))
# Senders get units only from mints, so a transfer is rejected by what its own sender has left.
_POOR = f"""poor AS (SELECT * REPLACE (CASE WHEN from_address = '{ZERO_ADDRESS}' THEN CAST(round(CAST(amount AS DOUBLE) / 3) AS BIGINT) ELSE amount END AS amount) FROM transfers),
sent AS (SELECT token, timestamp, transaction_index AS tx, log_index AS li, s, d, row_number() OVER (PARTITION BY token, s ORDER BY timestamp, transaction_index, log_index) AS i
  FROM (SELECT *, CASE WHEN from_address = '{ZERO_ADDRESS}' THEN to_address ELSE from_address END AS s,
               CASE WHEN from_address = '{ZERO_ADDRESS}' THEN amount ELSE -amount END AS d FROM poor)),
held AS (WITH RECURSIVE h AS (
  SELECT token, s, i, tx, li, timestamp, greatest(d, 0) AS left_, d >= 0 AS good FROM sent WHERE i = 1
  UNION ALL
  SELECT n.token, n.s, n.i, n.tx, n.li, n.timestamp, CASE WHEN h.left_ + n.d >= 0 THEN h.left_ + n.d ELSE h.left_ END, h.left_ + n.d >= 0
  FROM h JOIN sent n ON n.token = h.token AND n.s = h.s AND n.i = h.i + 1) SELECT * FROM h),
accepted AS (SELECT poor.* FROM poor JOIN held ON held.good AND held.token = poor.token AND held.timestamp = poor.timestamp
  AND held.tx = poor.transaction_index AND held.li = poor.log_index),
"""
check("t3_holder_counts_overdraw", lambda t: H.holder_counts(_poor(t)),
      f"WITH {_POOR}{_HOLD.replace('FROM transfers', 'FROM accepted')}\nFINAL SELECT * FROM hc", "", "log_index")
# Ten to the 40th times as many units: no number type of Spark or of the other engine holds them, the holders are the same.
_wide = lambda t, f: f.withColumn("amount", F.concat(F.col("amount").cast("string"), F.lit("0" * 40)))
check("t3_wide_amounts", lambda t: H.holder_counts(_wide(t, t.transfers)), f"WITH {_HOLD}\nFINAL SELECT * FROM hc", "", "log_index")
check("t3_wide_overdraw", lambda t: H.holder_counts(_wide(t, _poor(t))),
      f"WITH {_POOR}{_HOLD.replace('FROM transfers', 'FROM accepted')}\nFINAL SELECT * FROM hc", "", "log_index")
check("w16_wide_deltas", lambda t: H.holder_deltas(_wide(t, t.transfers)).groupBy("token").agg(
      F.sum("change").alias("holders"), F.count(F.lit(1)).alias("legs")),
      f"WITH {_HOLD}\nFINAL SELECT token, sum(CASE WHEN leg = 0 AND bal = 0 THEN -1 WHEN leg = 1 AND bal = d AND bal > 0 THEN 1 ELSE 0 END) AS holders, count(*) AS legs FROM bal GROUP BY 1",
      "", "holders")
_SNAP = "sn AS (SELECT token, date_trunc('day', timestamp) AS bucket_ts, arg_max(holders, row(timestamp, transaction_index, log_index)) AS holders FROM hc GROUP BY 1, 2)"
_snap = lambda t: H.holder_snapshots(_counts(t), "1 day")
check("t4_holder_snapshots", _snap, f"WITH {_HOLD}, {_SNAP}\nFINAL SELECT * FROM sn WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn)")
check("s10_holder_rows", lambda t: holders_rows(_snap(t)),
      f"WITH {_HOLD}, {_SNAP}\nFINAL SELECT bucket_ts AS timestamp, token, holders FROM sn WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn)")
check("a19_latest_holders", lambda t: H.latest_holders(_snap(t)),
      f"WITH {_HOLD}, {_SNAP}\nFINAL SELECT token, arg_max(holders, bucket_ts) AS holders FROM sn WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn) GROUP BY 1")
check("j18_moved_since", lambda t: _snap(t).join(t.transfers.groupBy("token").agg(F.max("timestamp").alias("last_ts")), "token")
      .filter(F.col("last_ts") >= F.col("bucket_ts")).groupBy("token").agg(F.count(F.lit(1)).alias("n")),
      f"""WITH {_HOLD}, {_SNAP}
FINAL SELECT token, count(*) AS n FROM sn JOIN (SELECT token, max(timestamp) AS lt FROM transfers GROUP BY 1) USING (token)
      WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn) AND lt >= bucket_ts GROUP BY 1""")
check("a31_first_transfers", lambda t: H.first_transfers(t.transfers).drop("sign"),
      """SELECT * EXCLUDE (rn, sign) FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY timestamp, transaction_index, log_index) AS rn
      FROM transfers) WHERE rn = 1""", "", "amount log_index")
check("w1_balance_history", lambda t: H.balance_history(t.transfers, "s_7", "tok_3"),
      """SELECT timestamp, transaction_index, log_index, sum(if(to_address = 's_7', amount, 0) - if(from_address = 's_7', amount, 0))
      OVER (ORDER BY timestamp, transaction_index, log_index) AS balance FROM transfers WHERE token = 'tok_3' AND (from_address = 's_7' OR to_address = 's_7')""",
      "", "log_index balance")
check("t6_after_checkpoint", lambda t: H.after_checkpoint(t.swaps, (END, 50, 3)).select("block_number"),
      f"SELECT block_number FROM swaps WHERE row(timestamp, transaction_index, log_index) > row(TIMESTAMP '{END}', 50, 3)")


def _balances(t):
    """Token balances before and after: each event is a transaction on one account."""
    return t.sql("""SELECT CAST(floor(block_number / 40) AS BIGINT) AS block_number,
        CASE WHEN block_number % 4 < 2 THEN NULL ELSE token_a END AS pre_mint, CASE WHEN block_number % 9 = 3 THEN NULL ELSE token_a END AS post_mint,
        CASE WHEN block_number % 4 < 2 THEN 0 ELSE 5 END AS pre_amount, CASE WHEN block_number % 3 = 0 THEN 0 ELSE 7 END AS post_amount FROM {s}""", s=t.swaps)


def _inits(t):
    return t.sql("""SELECT token_a AS token, CAST(floor(min(block_number) / 40) AS BIGINT) + 3 AS block_number FROM {s}
        WHERE token_a <> 'T3' GROUP BY token_a""", s=t.swaps)


check("t5_holder_counts_balances", lambda t: H.holder_counts_balances(_balances(t), _inits(t)),
      """WITH b AS (SELECT block_number // 40 AS bn, block_number AS e, token_a, block_number % 4 < 2 AS z, block_number % 3 = 0 AS y, block_number % 9 = 3 AS nopost FROM swaps),
i AS (SELECT token_a, min(e) // 40 + 3 AS born FROM b WHERE token_a <> 'T3' GROUP BY 1),
d AS (SELECT token_a, bn, sum(CASE WHEN z AND NOT y THEN 1 ELSE -1 END) AS c FROM b WHERE z <> y AND NOT (z AND nopost) GROUP BY 1, 2),
x AS (SELECT token_a, bn, c FROM d JOIN i USING (token_a) WHERE bn >= born UNION ALL SELECT token_a, born, 0 FROM i),
g AS (SELECT token_a, bn, sum(c) AS c FROM x GROUP BY 1, 2)
FINAL SELECT token_a AS token, bn AS block_number, sum(c) OVER (PARTITION BY token_a ORDER BY bn) AS holders FROM g""", "", "block_number holders")

# --- issuance and token dimension -------------------------------------------------------------------


def _mints(t):
    return t.swaps.select(F.col("token_a").alias("mint"), F.when(F.col("amount_a") > 0, "mint").otherwise("burn").alias("kind"),
                          F.abs("amount_a").cast("decimal(20,0)").alias("amount"), "block_number")


def _decimals(t):
    return t.swaps.select(F.col("token_a").alias("mint")).distinct().withColumn("decimals", F.when(F.col("mint") == "T1", 9).otherwise(3))


check("a20_issuance", lambda t: TK.issuance(_mints(t), _decimals(t)),
      "SELECT token_a AS mint, sum(amount_a) / if(token_a = 'T1', 1e9, 1e3) AS issuance FROM swaps GROUP BY 1", "issuance")
check("a20_issuance_history", lambda t: TK.issuance_history(_mints(t), _decimals(t), ["block_number"]).select("mint", "block_number", "issuance"),
      """SELECT token_a AS mint, block_number, sum(amount_a) OVER (PARTITION BY token_a ORDER BY block_number) / if(token_a = 'T1', 1e9, 1e3) AS issuance FROM swaps""",
      "issuance")
check("a20_wide", lambda t: TK.issuance(_wide(t, _mints(t)), _decimals(t), exact=True),
      """SELECT token_a AS mint, CAST(CAST(sum(amount_a) AS BIGINT) AS VARCHAR) || repeat('0', if(token_a = 'T1', 31, 37)) AS issuance FROM swaps GROUP BY 1""")
_MD = """SELECT token_a AS mint, block_number AS seq, concat('meta_', token_a) AS metadata_acc, account AS name, concat('S', CAST(log_index AS STRING)) AS symbol,
  amount_a > 0 AS mutable FROM {s} WHERE block_number % 10 = 4"""
_UP = """SELECT concat('meta_', token_a) AS metadata_acc, block_number AS seq, concat('new_', account) AS name,
  CASE WHEN block_number % 20 = 5 THEN concat('N', CAST(log_index AS STRING)) END AS symbol FROM {s} WHERE block_number % 10 = 5"""
check("a21_token_dim", lambda t: TK.token_dim(
      t.sql("SELECT token_a AS mint, 6 AS decimals, max(timestamp) AS created_at, min(block_number) AS seq FROM {s} GROUP BY token_a", s=t.swaps),
      t.sql(_MD, s=t.swaps), t.sql(_UP, s=t.swaps)),
      f"""WITH i AS (SELECT token_a AS mint, 6 AS decimals, max(timestamp) AS created_at, min(block_number) AS born FROM swaps GROUP BY 1),
md AS ({_MD.format(s='swaps')}), up AS ({_UP.format(s='swaps')}),
m AS (SELECT md.* FROM md JOIN i USING (mint) WHERE md.seq > born), acc AS (SELECT metadata_acc, max(mint) AS mint, max(seq) AS since FROM m GROUP BY 1),
ev AS (SELECT mint, seq, metadata_acc, name, symbol, mutable FROM m UNION ALL
  SELECT acc.mint, up.seq, up.metadata_acc, up.name, up.symbol, NULL FROM up JOIN acc USING (metadata_acc) WHERE up.seq > since)
FINAL SELECT i.mint, decimals, created_at, arg_max(metadata_acc, seq) AS metadata_acc, arg_max(name, seq) AS name,
  arg_max(symbol, seq) FILTER (symbol IS NOT NULL) AS symbol, arg_max(mutable, seq) FILTER (mutable IS NOT NULL) AS mutable
  FROM i LEFT JOIN ev ON ev.mint = i.mint GROUP BY 1, 2, 3""", "", "decimals")
check("s18_load_token_dim", lambda t: TK.load_token_dim(t.swaps.select(
      F.upper("token_a").alias("address"), (F.col("block_number") % 4 + 15).alias("decimals")).distinct()),
      "SELECT DISTINCT lower(token_a) AS address, block_number % 4 + 15 AS decimals FROM swaps WHERE block_number % 4 + 15 <> 18")
check("s11_first_transfer_rows", lambda t: block_range(H.first_transfers(t.transfers).withColumn("block_number", F.col("transaction_index")), 0, 10 ** 9)
      .select("token", "from_address"), f"SELECT DISTINCT token, '{ZERO_ADDRESS}' AS from_address FROM transfers")
check("a23_holder_replace", lambda t: replace_latest(_snap(t), ["token"], ["bucket_ts"]).select("token", "holders"),
      f"WITH {_HOLD}, {_SNAP}\nFINAL SELECT token, arg_max(holders, bucket_ts) AS holders FROM sn WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn) GROUP BY 1")
