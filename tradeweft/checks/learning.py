"""Checks of features, labels, metrics and the backtest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradeweft.checks.base import END, check
from tradeweft.checks.rollups import _C10, _FEE, _FLOW, _OFLOW, _SMART, _smart
from tradeweft.functions.market import bucket_of
from tradeweft.operators import backtest as BT
from tradeweft.operators import candles as C
from tradeweft.operators import features as FE
from tradeweft.operators import labels as L
from tradeweft.operators import metrics as MX
from tradeweft.operators import models as MD
from tradeweft.session import session_dir, written_table

# --- candle features ---------------------------------------------------------------------------
_CP = "cd AS (" + _C10.format(w="1 hour") + """),
cp AS (SELECT token_a AS token, pool_address AS pool, bucket_ts, close_token_a_usdc AS close_price, open_token_a_usdc AS open_price,
  high_token_a_usdc AS high_price, low_token_a_usdc AS low_price, volume_usdc, CAST(swap_count AS BIGINT) AS swap_count, avg_slippage_pct, max_pool_tvl_usdc FROM cd)"""
_W = "WINDOW w AS (PARTITION BY token, pool ORDER BY bucket_ts)"
_fr = lambda n: f"(PARTITION BY token, pool ORDER BY bucket_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_CPD = "close_price open_price high_price low_price volume_usdc avg_slippage_pct max_pool_tvl_usdc"


def _cp(t):
    return FE.candle_prices(C.candles10s(t.swaps, "1 hour"))


_LR = ", ".join(f"ln(close_price / lag(close_price, {k}) OVER w) AS log_return_{k}" for k in (1, 18, 36, 180))
_LRD = " ".join(f"log_return_{k}" for k in (1, 18, 36, 180))
check("w3_log_returns", lambda t: FE.log_returns(_cp(t)), f"WITH {_CP}\nFINAL SELECT *, {_LR} FROM cp {_W}", f"{_CPD} {_LRD}")
check("w4_rolling_vol", lambda t: FE.rolling_vol(FE.log_returns(_cp(t), (1,))),
      f"""WITH {_CP}, l AS (SELECT *, ln(close_price / lag(close_price, 1) OVER w) AS log_return_1 FROM cp {_W})
FINAL SELECT *, stddev_samp(log_return_1) OVER {_fr(18)} AS volatility_18, stddev_samp(log_return_1) OVER {_fr(36)} AS volatility_36 FROM l""",
      f"{_CPD} log_return_1 volatility_18 volatility_36")
check("w5_atr", lambda t: FE.atr(_cp(t)), f"WITH {_CP}\nFINAL SELECT *, avg(high_price - low_price) OVER {_fr(20)} AS atr_20 FROM cp", _CPD + " atr_20")
check("w6_volume_ratio", lambda t: FE.volume_ratio(_cp(t)),
      f"WITH {_CP}\nFINAL SELECT *, avg(volume_usdc) OVER {_fr(20)} AS volume_sma_20, volume_usdc / nullif(avg(volume_usdc) OVER {_fr(20)}, 0) AS volume_ratio FROM cp",
      _CPD + " volume_sma_20 volume_ratio")
check("w7_tvl_change", lambda t: FE.tvl_change(_cp(t)),
      f"WITH {_CP}\nFINAL SELECT *, max_pool_tvl_usdc / lag(max_pool_tvl_usdc, 1) OVER w - 1 AS tvl_change_pct FROM cp {_W}", _CPD + " tvl_change_pct")
check("w8_slippage_trend", lambda t: FE.slippage_trend(_cp(t)).select("token", "pool", "bucket_ts", "slippage_sma_12", "slippage_spike"),
      f"""WITH {_CP}\nFINAL SELECT token, pool, bucket_ts, avg(avg_slippage_pct) OVER {_fr(12)} AS slippage_sma_12,
      avg_slippage_pct > avg(avg_slippage_pct) OVER {_fr(36)} AS slippage_spike FROM cp""", "slippage_sma_12")
check("w11_warmup", lambda t: FE.warmup(_cp(t), 600).select("token", "pool", "bucket_ts"),
      f"WITH {_CP}\nFINAL SELECT token, pool, bucket_ts FROM cp QUALIFY bucket_ts >= min(bucket_ts) OVER (PARTITION BY token, pool) + INTERVAL 600 MINUTE")
check("w14_peak_drawdown", lambda t: L.peak_drawdown(_cp(t)).select("token", "pool", "bucket_ts", "peak", "drawdown"),
      f"WITH {_CP}\nFINAL SELECT token, pool, bucket_ts, max(close_price) OVER w AS peak, (max(close_price) OVER w - close_price) / max(close_price) OVER w AS drawdown FROM cp {_W}",
      "peak drawdown")
check("w15_future_max", lambda t: L.future_max(_cp(t)).select("token", "pool", "bucket_ts", "future_max"),
      f"""WITH {_CP}\nFINAL SELECT token, pool, bucket_ts, max(close_price) OVER (PARTITION BY token, pool ORDER BY bucket_ts
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS future_max FROM cp""", "future_max")
_PF = f"""l AS (SELECT *, {_LR} FROM cp {_W}),
pf AS (SELECT *, stddev_samp(log_return_1) OVER {_fr(18)} AS volatility_18, stddev_samp(log_return_1) OVER {_fr(36)} AS volatility_36,
  avg(high_price - low_price) OVER {_fr(20)} AS atr_20, avg(volume_usdc) OVER {_fr(20)} AS volume_sma_20,
  volume_usdc / nullif(avg(volume_usdc) OVER {_fr(20)}, 0) AS volume_ratio, max_pool_tvl_usdc / lag(max_pool_tvl_usdc, 1) OVER w - 1 AS tvl_change_pct,
  avg(avg_slippage_pct) OVER {_fr(12)} AS slippage_sma_12, round(avg_slippage_pct, 9) > round(avg(avg_slippage_pct) OVER {_fr(36)}, 9) AS slippage_spike FROM l {_W})"""
_PFD = f"{_CPD} {_LRD} volatility_18 volatility_36 atr_20 volume_sma_20 volume_ratio tvl_change_pct slippage_sma_12"
check("m2_price_features", lambda t: FE.price_features(_cp(t)).drop("slippage_spike"),
      f"WITH {_CP}, {_PF}\nFINAL SELECT * EXCLUDE (slippage_spike) FROM pf", _PFD)

# --- flow features -------------------------------------------------------------------------------
_frm = lambda n: f"(PARTITION BY token, pool ORDER BY minute_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_SR = f"""SELECT *, smart_sell_volume / nullif(smart_buy_volume + smart_sell_volume, 0) AS smart_sell_ratio,
  sum(smart_sell_volume) OVER {_frm(10)} AS smart_sell_volume_10min, sum(smart_buy_volume) OVER {_frm(10)} AS smart_buy_volume_10min FROM fl"""
_SRD = "smart_buy_volume smart_sell_volume smart_sell_ratio smart_sell_volume_10min smart_buy_volume_10min"
check("m3_smart_money_features", lambda t: FE.smart_money_features(t.swaps, _smart(t), interval="1 hour"),
      f"{_SMART}, fl AS ({_FLOW})\nFINAL {_SR}", _SRD)
check("w9_smart_rolling", lambda t: FE.smart_rolling(t.sql("""SELECT token_a AS token, pool_address AS pool, date_trunc('DAY', timestamp) AS minute_ts,
      sum(if(amount_a > 0, amount_a, 0)) AS smart_buy_volume, sum(if(amount_a < 0, -amount_a, 0)) AS smart_sell_volume FROM {s} GROUP BY 1, 2, 3""", s=t.swaps)),
      f"""WITH fl AS (SELECT token_a AS token, pool_address AS pool, date_trunc('day', timestamp) AS minute_ts, sum(if(amount_a > 0, amount_a, 0)) AS smart_buy_volume,
      sum(if(amount_a < 0, -amount_a, 0)) AS smart_sell_volume FROM swaps GROUP BY 1, 2, 3)\nFINAL {_SR}""", _SRD)
_IMB = f"""of AS ({_OFLOW.format(u='hour')}), im AS (SELECT *, (buy_volume_usdc - sell_volume_usdc) / nullif(buy_volume_usdc + sell_volume_usdc, 0) AS volume_imbalance,
  (buy_count - sell_count) / nullif(buy_count + sell_count, 0) AS count_imbalance, avg_slippage > lag(avg_slippage, 5) OVER w AS slippage_increasing,
  avg_tvl / lag(avg_tvl, 1) OVER w - 1 AS tvl_change_1min FROM of WINDOW w AS (PARTITION BY token, pool ORDER BY minute_ts)),
ff AS (SELECT *, avg(volume_imbalance) OVER {_frm(5)} AS imbalance_5min_avg, stddev_samp(volume_imbalance) OVER {_frm(10)} AS imbalance_10min_std FROM im)"""
_IMD = """buy_volume_usdc sell_volume_usdc avg_slippage p80_slippage avg_tvl volume_imbalance count_imbalance tvl_change_1min imbalance_5min_avg imbalance_10min_std"""
check("m4_order_flow_features", lambda t: FE.order_flow_features(t.swaps, interval="1 hour"), f"WITH {_IMB}\nFINAL SELECT * FROM ff", _IMD)
check("w10_imbalance", lambda t: FE.order_flow_features(t.swaps, interval="1 hour").select(
      "token", "pool", "minute_ts", "volume_imbalance", "imbalance_5min_avg", "imbalance_10min_std", "slippage_increasing"),
      f"WITH {_IMB}\nFINAL SELECT token, pool, minute_ts, volume_imbalance, imbalance_5min_avg, imbalance_10min_std, slippage_increasing FROM ff",
      "volume_imbalance imbalance_5min_avg imbalance_10min_std")
_flow = lambda t: FE.order_flow_features(t.swaps, interval="1 hour").select("token", "pool", "minute_ts", "volume_imbalance", "avg_tvl")
_smartf = lambda t: FE.smart_money_features(t.swaps, _smart(t), interval="1 hour").select("token", "pool", "minute_ts", "smart_sell_ratio")
check("j20_merge_features", lambda t: FE.merge_features(_cp(t).select("token", "pool", "bucket_ts", "close_price"), _smartf(t), _flow(t)),
      f"""{_SMART}, fl AS ({_FLOW}), sr AS ({_SR}), {_CP}, {_IMB}
FINAL SELECT cp.token, cp.pool, bucket_ts, close_price AS price_close_price, smart_sell_ratio AS smart_smart_sell_ratio,
      volume_imbalance AS flow_volume_imbalance, avg_tvl AS flow_avg_tvl FROM cp
      LEFT JOIN sr ON sr.token = cp.token AND sr.pool = cp.pool AND sr.minute_ts = bucket_ts
      LEFT JOIN ff ON ff.token = cp.token AND ff.pool = cp.pool AND ff.minute_ts = bucket_ts""",
      "price_close_price smart_smart_sell_ratio flow_volume_imbalance flow_avg_tvl")

# --- signals: age, liquidity, cost -----------------------------------------------------------------
_AGED = """aged AS (SELECT s.*, date_diff('day', x.token_a_creation_date, s.timestamp) AS age_days FROM signals s JOIN xs x ON x.block_number = s.signal_id),
tv AS (SELECT s.signal_id, avg(v.pool_tvl) AS avg_tvl_usdc FROM signals s JOIN tvl v ON v.token_a = s.token AND v.timestamp <= s.timestamp
  AND v.timestamp >= s.timestamp - INTERVAL 1 HOUR WHERE v.pool_tvl > 0 GROUP BY 1)"""
check("a29_token_age_tvl", lambda t: FE.token_age_tvl(t.signals, t.xs).select("signal_id", "age_days", "avg_tvl_usdc"),
      f"WITH {_AGED}\nFINAL SELECT signal_id, age_days, avg_tvl_usdc FROM aged LEFT JOIN tv USING (signal_id)", "avg_tvl_usdc")
_BK = """CASE WHEN a BETWEEN 0 AND 7 AND v BETWEEN 0 AND 100000 THEN 'new_tokens' WHEN a BETWEEN 7 AND 30 AND v BETWEEN 100000 AND 1000000
  THEN 'emerging' WHEN a BETWEEN 30 AND 365 AND v BETWEEN 1000000 AND 10000000 THEN 'established'
  WHEN a BETWEEN 365 AND 9999 AND v >= 10000000 THEN 'blue_chip' ELSE 'new_tokens' END"""
check("m1_liquidity_bucket", lambda t: FE.liquidity_bucket(t.signals, t.xs.withColumns(
      {"pool_token_a_reserve": F.col("pool_token_a_reserve") * 20})).select("signal_id", "bucket"),
      f"""WITH aged AS (SELECT s.*, date_diff('day', x.token_a_creation_date, s.timestamp) AS age_days FROM signals s JOIN xs x ON x.block_number = s.signal_id),
tv AS (SELECT s.signal_id, avg(abs(v.pool_token_a_reserve * 20 * v.token_a_usdc_price) + abs(v.pool_token_b_reserve * v.token_b_usdc_price)) AS avg_tvl
  FROM signals s JOIN swaps v ON v.token_a = s.token AND v.timestamp <= s.timestamp AND v.timestamp >= s.timestamp - INTERVAL 1 HOUR GROUP BY 1)
FINAL SELECT signal_id, {_BK} AS bucket FROM (SELECT signal_id, age_days AS a, coalesce(avg_tvl, 0) AS v FROM aged LEFT JOIN tv USING (signal_id))""")
_SP = """sp AS (SELECT s.signal_id, quantile_cont(abs(slippage_pct), 0.2) AS slippage_low, quantile_cont(abs(slippage_pct), 0.5) AS slippage_high
  FROM signals s JOIN swaps v ON v.token_a = s.token AND v.pool_address = s.pool AND v.timestamp <= s.timestamp AND v.timestamp >= s.timestamp - INTERVAL 1 HOUR
  AND abs(v.amount_b * v.token_b_usdc_price) BETWEEN s.size_usdc * 0.5 AND s.size_usdc * 2 GROUP BY 1)"""
check("a28_slippage_profile", lambda t: FE.slippage_profile(t.signals, t.swaps), f"WITH {_SP}\nFINAL SELECT * FROM sp", "slippage_low slippage_high")
check("m5_cost_model", lambda t: FE.cost_model(t.signals, t.swaps).select("signal_id", "dex_fee", "slippage"),
      f"""WITH {_SP}\nFINAL SELECT s.signal_id, {_FEE} AS dex_fee, CASE WHEN slippage_low <> 0 AND slippage_high <> 0 THEN (slippage_low + slippage_high) / 200
      ELSE 0.01 END AS slippage FROM signals s LEFT JOIN sp USING (signal_id)""", "dex_fee slippage")

# --- training rows and labels -------------------------------------------------------------------------


def _tagged(t):
    """Signals with a bucket and costs from plain projections."""
    return t.signals.withColumns({
        "bucket": bucket_of((F.col("signal_id") % 40).cast("int"), (F.col("signal_id") % 7 * 100000).cast("double")),
        "dex_fee": F.lit(0.003), "slippage": F.lit(0.01)})


_TAG = f"""tg AS (SELECT *, 0.003 AS dex_fee, 0.01 AS slippage, CASE bucket WHEN 'new_tokens' THEN 2 WHEN 'emerging' THEN 6
  WHEN 'established' THEN 12 ELSE 24 END AS hz FROM (SELECT *, {_BK} AS bucket FROM (SELECT *, signal_id % 40 AS a, signal_id % 7 * 100000 AS v FROM signals)))"""
_SW = f"""{_CP}, {_TAG}, sw AS (SELECT tg.* EXCLUDE (a, v), cp.bucket_ts, close_price FROM tg JOIN cp USING (token, pool)
  WHERE cp.bucket_ts >= tg.timestamp AND cp.bucket_ts <= tg.timestamp + to_hours(hz))"""
check("j19_signal_windows", lambda t: L.signal_windows(_tagged(t), _cp(t).select("token", "pool", "bucket_ts", "close_price")).select(
      "signal_id", "bucket_ts", "close_price"), f"WITH {_SW}\nFINAL SELECT signal_id, bucket_ts, close_price FROM sw", "close_price")


def _training(t):
    return L.training_set(_tagged(t), _cp(t).select("token", "pool", "bucket_ts", F.col("close_price").alias("price_close_price"),
                                                    F.col("volume_usdc").alias("price_volume_usdc")))


_TS = f"""{_SW}, ts AS (SELECT *, close_price / entry_price * (1 - dex_fee - slippage) - 1 AS net_return_current,
  max(close_price) OVER (PARTITION BY signal_id ORDER BY bucket_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fm,
  (epoch_us(bucket_ts) - epoch_us(timestamp)) / 60e6 AS minutes_since_entry FROM sw)"""
check("m6_training_set", lambda t: _training(t).select("signal_id", "timestamp", "current_price", "net_return_current", "upside_left", "minutes_since_entry"),
      f"""WITH {_TS}\nFINAL SELECT signal_id, bucket_ts AS timestamp, close_price AS current_price, net_return_current,
      fm / entry_price * (1 - dex_fee - slippage) - 1 - net_return_current AS upside_left, minutes_since_entry FROM ts""",
      "current_price net_return_current upside_left minutes_since_entry")
_DD = f"""{_TS}, nx AS (SELECT *, net_return_current - min(net_return_current) OVER (PARTITION BY signal_id ORDER BY bucket_ts
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d FROM ts),
dd AS (SELECT *, greatest(0, coalesce(max(d) OVER (PARTITION BY signal_id ORDER BY bucket_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)) AS mdd FROM nx)"""
check("m7_drawdown_labels", lambda t: L.drawdown_labels(_training(t), 0.0512).select("signal_id", "timestamp", "max_future_drawdown", "drawdown_label"),
      f"WITH {_DD}\nFINAL SELECT signal_id, bucket_ts AS timestamp, mdd AS max_future_drawdown, CAST(mdd > 0.0512 AS BIGINT) AS drawdown_label FROM dd", "max_future_drawdown")
check("m8_hindsight_labels", lambda t: L.hindsight_labels(_training(t)),
      f"""WITH {_TS}, pk AS (SELECT *, greatest(entry_price, max(close_price) OVER (PARTITION BY signal_id ORDER BY bucket_ts)) AS pk FROM ts),
mx AS (SELECT *, max((pk - close_price) / pk) OVER (PARTITION BY signal_id ORDER BY bucket_ts) AS dd FROM pk),
ut AS (SELECT *, net_return_current - 0.01 * minutes_since_entry / 60 - 0.1 * dd AS u FROM mx)
FINAL SELECT signal_id, arg_max(bucket_ts, u) AS best_exit, max(u) AS best_utility FROM ut GROUP BY 1""", "best_utility")
check("m9_time_split", lambda t: L.time_split(t.signals, END)[0].agg(F.count(F.lit(1)).alias("train")).crossJoin(
      L.time_split(t.signals, END)[1].agg(F.count(F.lit(1)).alias("validation"))),
      f"SELECT count(*) FILTER (timestamp < TIMESTAMP '{END}') AS train, count(*) FILTER (timestamp >= TIMESTAMP '{END}') AS validation FROM signals")
check("m10_feature_matrix", lambda t: MX.feature_matrix(FE.log_returns(_cp(t), (1,)).select("token", "pool", "bucket_ts", "log_return_1", "swap_count")),
      f"WITH {_CP}\nFINAL SELECT token, pool, bucket_ts, coalesce(ln(close_price / lag(close_price, 1) OVER w), 0) AS log_return_1, swap_count FROM cp {_W}",
      "log_return_1 swap_count")


def _fit(t):
    rows = written_table(_training(t), "training")
    train, held = L.time_split(rows, END)
    models = MD.fit_drawdown(train, min_rows=20, models=MD.fit_upside(train, held, min_rows=20), validation=held)
    return models, rows


def _predictions(t):
    models, rows = _fit(t)
    return models.should_sell(rows).select("signal_id", "timestamp", "bucket", "upside_pred", "drawdown_prob", "sell")


def _metrics_table(t):
    models, _ = _fit(t)
    return t.spark.createDataFrame([(b, m.get("rmse"), m.get("mae"), m.get("accuracy"), m.get("auc"))
                                    for b, m in sorted(models.metrics.items())],
                                   "bucket string, rmse double, mae double, accuracy double, auc double")


check("m11_m13_model_decisions", _predictions)
check("m12_model_metrics", _metrics_table)
def _reloaded(t):
    """Rows per bucket with a model, those that models read back from files score alike, and those that keep the sell rule."""
    models, rows = _fit(t)
    path = f"{session_dir(t.spark)}/models-{uuid.uuid4().hex}"
    models.save(path)
    again = MD.SellModels.load(path, {"upside": list(models.upside), "drawdown": list(models.drawdown)})
    key = ["signal_id", "timestamp", "bucket"]
    before = models.should_sell(rows).select(*key, "upside_pred", "drawdown_prob", "sell")
    after = again.predict(rows).select(*key, F.col("upside_pred").alias("_u"), F.col("drawdown_prob").alias("_d"))
    c = F.col
    return before.join(after, key).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((c("upside_pred") == c("_u")) & (c("drawdown_prob") == c("_d"))).alias("same"),
        F.count_if((c("sell") == 1) == ((c("_u") < 0.008) & (c("_d") > 0.4))).alias("by_rule"))


check("m11_m14_gates_and_reload", _reloaded,
      f"""WITH {_TS}, g AS (SELECT bucket FROM ts WHERE bucket_ts < TIMESTAMP '{END}' GROUP BY 1 HAVING count(*) >= 20)
FINAL SELECT bucket, count(*) AS n, count(*) AS same, count(*) AS by_rule FROM ts WHERE bucket IN (SELECT bucket FROM g) GROUP BY 1""")
check("m13_sell_signals", lambda t: BT.sell_signals(t.signals.select(
      "signal_id", ((F.col("signal_id") % 20) / 1000).alias("upside_pred"), ((F.col("signal_id") % 9) / 10).alias("drawdown_prob"))).select("signal_id", "sell"),
      "SELECT signal_id, CAST(signal_id % 20 / 1000 < 0.008 AND signal_id % 9 / 10 > 0.4 AS BIGINT) AS sell FROM signals")
check("m15_regression_metrics", lambda t: MX.regression_metrics(t.swaps.select(
      F.col("token_a_usdc_price").alias("prediction"), (F.col("amount_a") / 50).alias("label"), "dex"), ["dex"]),
      """SELECT dex, sqrt(avg((token_a_usdc_price - amount_a / 50) ** 2)) AS rmse, avg(abs(token_a_usdc_price - amount_a / 50)) AS mae FROM swaps GROUP BY 1""", "rmse mae")
check("m16_binary_metrics", lambda t: MX.binary_metrics(t.swaps.select(
      (F.col("amount_a") > 0).cast("int").alias("label"), ((F.col("block_number") * 17 % 101) / 101).alias("score"))),
      """WITH v AS (SELECT CAST(amount_a > 0 AS INT) AS y, block_number * 17 % 101 / 101 AS s FROM swaps),
g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM v GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
FINAL SELECT (SELECT avg(CAST(CAST(s > 0.5 AS INT) = y AS INT)) FROM v) AS accuracy, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auc FROM r""", "accuracy auc")
_QP = "[" + ", ".join(f"token_a_usdc_price + {i} * 0.01" for i in range(9)) + "]"
_q = lambda t: t.swaps.select("block_number", (F.col("amount_a") / 40).alias("label"), F.array(
    *[F.col("token_a_usdc_price") + i * 0.01 for i in range(9)]).alias("quantiles"))
check("m17_pinball_loss", lambda t: MX.pinball_loss(_q(t)),
      """SELECT avg(greatest(q * e, (q - 1) * e)) AS pinball_loss FROM (SELECT (i + 1) * 0.1 AS q, amount_a / 40 - (token_a_usdc_price + i * 0.01) AS e
      FROM swaps, range(9) r(i))""", "pinball_loss")
check("m17_quantile_point", lambda t: MX.quantile_point(_q(t)).select("block_number", "point", "spread_q30_q70"),
      "SELECT block_number, token_a_usdc_price + 0.04 AS point, 0.04 AS spread_q30_q70 FROM swaps", "point spread_q30_q70")
check("m18_robust_scale", lambda t: MX.robust_scale(t.swaps.select("block_number", "amount_a", F.when(
      F.col("log_index") > 2, F.col("amount_b")).alias("amount_b")), ["amount_a", "amount_b"]),
      """WITH v AS (SELECT block_number, amount_a, if(log_index > 2, amount_b, 0) AS amount_b FROM swaps),
q AS (SELECT quantile_cont(amount_a, [0.25, 0.5, 0.75]) AS qa, quantile_cont(amount_b, [0.25, 0.5, 0.75]) AS qb FROM v)
FINAL SELECT block_number, (amount_a - qa[2]) / (qa[3] - qa[1]) AS amount_a, (amount_b - qb[2]) / (qb[3] - qb[1]) AS amount_b FROM v, q""", "amount_a amount_b")
check("m19_w17_sequences", lambda t: FE.sequences(_training(t).withColumn("row_id", F.col("signal_id")), 4, ["current_price", "net_return_current"],
      order=("timestamp", "row_id")).select("token", "pool", "timestamp", "row_id", "upside_left", F.aggregate(
          "sequence", F.lit(0.0), lambda a, x: a + x[0] + 10 * x[1]).alias("digest")),
      f"""WITH {_TS}\nFINAL SELECT token, pool, bucket_ts AS timestamp, signal_id AS row_id, fm / entry_price * (1 - dex_fee - slippage) - 1 - net_return_current AS upside_left,
      sum(close_price + 10 * net_return_current) OVER w AS digest FROM ts
      WINDOW w AS (PARTITION BY token, pool ORDER BY bucket_ts, signal_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 4""", "upside_left digest")

# --- backtest -----------------------------------------------------------------------------------------


def _atr(t):
    return FE.atr(_cp(t)).select("token", "pool", "bucket_ts", "close_price", "atr_20")


def _preds(t):
    return t.sql("""SELECT signal_id, bucket_ts, (signal_id % 20) / 1000.0D AS upside_pred, (signal_id % 9) / 10.0D AS drawdown_prob
        FROM {w}""", w=L.signal_windows(_tagged(t), _atr(t)))


_SIM = f"""{_CP}, {_TAG}, atrs AS (SELECT *, avg(high_price - low_price) OVER {_fr(20)} AS atr FROM cp),
sw AS (SELECT tg.*, atrs.bucket_ts, close_price AS p, atr FROM tg JOIN atrs USING (token, pool) WHERE atrs.bucket_ts >= tg.timestamp AND atrs.bucket_ts <= tg.timestamp + to_hours(hz)),
pk AS (SELECT *, greatest(entry_price, max(p) OVER w) AS pk, count(*) OVER (PARTITION BY signal_id) AS pts FROM sw WINDOW w AS (PARTITION BY signal_id ORDER BY bucket_ts)),
ex AS (SELECT *, CASE WHEN (atr > 0 AND p <= pk - 2.5 * atr) OR p / entry_price - 1 < -0.05 THEN 'stop_loss'
  WHEN {{model}} THEN 'model' END AS why FROM pk WHERE pts >= 2),
fx AS (SELECT *, min(bucket_ts) FILTER (why IS NOT NULL) OVER (PARTITION BY signal_id) AS x FROM ex),
tr AS (SELECT signal_id, any_value(timestamp) AS entry_time, max(bucket_ts) AS exit_time, any_value(token) AS token, any_value(pool) AS pool,
  any_value(bucket) AS bucket, any_value(entry_price) AS entry_price, arg_max(p, bucket_ts) AS exit_price, any_value(size_usdc) AS trade_size_usdc,
  CASE any_value(dex) WHEN 'raydium' THEN 0.0025 WHEN 'orca' THEN 0.003 WHEN 'uniswap_v3' THEN 0.0005 ELSE 0.0025 END AS dex_fee, 0.01 AS slippage,
  max((pk - p) / pk) AS max_drawdown, coalesce(any_value(why) FILTER (bucket_ts = x), 'timeout') AS exit_reason
  FROM fx WHERE x IS NULL OR bucket_ts <= x GROUP BY 1),
trades AS (SELECT *, exit_price / entry_price - 1 AS gross_return, exit_price / entry_price * (1 - dex_fee - slippage) - 1 AS net_return,
  (epoch_us(exit_time) - epoch_us(entry_time)) / 3.6e9 AS holding_time_hours FROM tr)"""
_MODEL = "signal_id % 20 / 1000 < 0.008 AND signal_id % 9 / 10 > 0.4"
_SIMM, _SIM0 = _SIM.format(model=_MODEL), _SIM.format(model="false")
_TRD = "entry_price exit_price trade_size_usdc dex_fee slippage max_drawdown gross_return net_return holding_time_hours"


def _trades(t):
    return BT.simulate_trades(_tagged(t), _atr(t), _preds(t))


check("b1_simulate_trades", _trades, f"WITH {_SIMM}\nFINAL SELECT * FROM trades", _TRD)
check("b3_simulate_without_model", lambda t: BT.simulate_trades(_tagged(t), _atr(t)), f"WITH {_SIM0}\nFINAL SELECT * FROM trades", _TRD)
_PERF = """SELECT {g} count(*) AS total_trades, avg(CAST(net_return > 0 AS INT)) AS win_rate, avg(net_return) AS avg_return, median(net_return) AS median_return,
  exp(sum(ln(1 + net_return))) - 1 AS total_return, avg(net_return) / stddev_samp(net_return) AS sharpe_ratio, max(max_drawdown) AS max_drawdown,
  avg(max_drawdown) AS avg_drawdown, (exp(sum(ln(1 + net_return))) - 1) / max(max_drawdown) AS calmar_ratio,
  coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(net_return) FILTER (net_return < 0), 0) AS avg_loss,
  coalesce(max(net_return) FILTER (net_return > 0), 0) AS best_win, coalesce(min(net_return) FILTER (net_return < 0), 0) AS worst_loss,
  coalesce(sum(net_return) FILTER (net_return > 0), 0) / coalesce(abs(sum(net_return) FILTER (net_return < 0)), 0.001) AS profit_factor,
  quantile_cont(net_return, 0.05) AS var_95, any_value(cv) AS cvar_95, avg(holding_time_hours) AS avg_holding_time_hours, median(holding_time_hours) AS median_holding_time_hours,
  avg(CAST(exit_reason = 'model' AS INT)) * 100 AS model_exit_pct, avg(CAST(exit_reason = 'stop_loss' AS INT)) * 100 AS stop_exit_pct,
  avg(CAST(exit_reason = 'timeout' AS INT)) * 100 AS timeout_exit_pct FROM ({src}) {gb}"""
_PD = """win_rate avg_return median_return total_return sharpe_ratio max_drawdown avg_drawdown calmar_ratio avg_win avg_loss best_win worst_loss profit_factor
  var_95 cvar_95 avg_holding_time_hours median_holding_time_hours model_exit_pct stop_exit_pct timeout_exit_pct"""
check("b4_performance", lambda t: BT.performance(_trades(t)), f"WITH {_SIMM}\nFINAL " + _PERF.format(
      g="", gb="", src="SELECT *, (SELECT avg(net_return) FROM trades WHERE net_return <= (SELECT quantile_cont(net_return, 0.05) FROM trades)) AS cv FROM trades"), _PD)
_BYM = """SELECT a.*, (SELECT avg(b.net_return) FROM trades b WHERE b.bucket = a.bucket AND b.net_return <= v.q) AS cv
  FROM trades a JOIN (SELECT bucket, quantile_cont(net_return, 0.05) AS q FROM trades GROUP BY 1) v ON v.bucket = a.bucket"""
check("b8_compare", lambda t: BT.compare(_trades(t), "bucket"), f"WITH {_SIMM}\nFINAL " + _PERF.format(g="bucket,", gb="GROUP BY bucket", src=_BYM), _PD)
check("b5_fixed_time_exits", lambda t: BT.fixed_time_exits(t.signals, _cp(t).select("token", "pool", "bucket_ts", "close_price")),
      f"""WITH {_CP}, f AS (SELECT signal_id, token, pool, entry_price, timestamp, h AS hours, timestamp + to_hours(CAST(h AS INT)) AS at FROM signals, (SELECT unnest([1,2,4,8,12,24]) AS h))
FINAL SELECT signal_id, hours, close_price AS exit_price, close_price / entry_price * (1 - 0.0025 - 0.01) - 1 AS net_return
      FROM f ASOF JOIN cp ON cp.token = f.token AND cp.pool = f.pool AND cp.bucket_ts <= f.at WHERE cp.bucket_ts >= f.timestamp""", "exit_price net_return", "hours")
check("b5_baseline_summary", lambda t: BT.baseline_summary(BT.fixed_time_exits(t.signals, _cp(t).select("token", "pool", "bucket_ts", "close_price")), "hours"),
      f"""WITH {_CP}, f AS (SELECT signal_id, token, pool, entry_price, timestamp, h AS hours, timestamp + to_hours(CAST(h AS INT)) AS at FROM signals, (SELECT unnest([1,2,4,8,12,24]) AS h)),
g AS (SELECT hours, close_price / entry_price * (1 - 0.0025 - 0.01) - 1 AS r FROM f ASOF JOIN cp ON cp.token = f.token AND cp.pool = f.pool AND cp.bucket_ts <= f.at WHERE cp.bucket_ts >= f.timestamp)
FINAL SELECT hours, avg(r) AS avg_return, avg(r) / stddev_pop(r) AS sharpe_ratio, avg(CAST(r > 0 AS INT)) AS win_rate FROM g GROUP BY 1""",
      "avg_return sharpe_ratio win_rate", "hours")
check("b6_take_profit_exits", lambda t: BT.take_profit_exits(_tagged(t), _cp(t).select("token", "pool", "bucket_ts", "close_price")).select(
      "signal_id", "pct", "exit_price", "hit", "net_return"),
      f"""WITH {_SW}, g AS (SELECT signal_id, entry_price, bucket_ts, close_price, pct, close_price / entry_price - 1 >= pct / 100.0 AS hit FROM sw, (SELECT unnest([2,5,10,15]) AS pct)),
h AS (SELECT signal_id, pct, any_value(entry_price) AS e, coalesce(arg_min(close_price, bucket_ts) FILTER (hit), arg_max(close_price, bucket_ts)) AS exit_price, bool_or(hit) AS hit FROM g GROUP BY 1, 2)
FINAL SELECT signal_id, pct, exit_price, hit, exit_price / e * (1 - 0.0025 - 0.01) - 1 AS net_return FROM h""", "exit_price net_return", "pct")
check("b7_walk_forward", lambda t: BT.walk_forward(t.signals, 10, 3, 4).groupBy("window_no", "part").agg(F.count(F.lit(1)).alias("n")),
      """WITH z AS (SELECT *, date_diff('day', (SELECT min(timestamp) FROM signals), timestamp) AS d FROM signals)
FINAL SELECT k AS window_no, CASE WHEN d - k * 3 < 10 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM z, range(100) r(k)
      WHERE d >= k * 3 AND d < k * 3 + 14 GROUP BY 1, 2""", "", "window_no")
check("b9_equity_curve", lambda t: BT.equity_curve(_trades(t)),
      f"""WITH {_SIMM}\nFINAL SELECT signal_id, entry_time, row_number() OVER w AS trade_no, exp(sum(ln(1 + net_return)) OVER w) AS cumulative_return
      FROM trades WINDOW w AS (ORDER BY entry_time, signal_id ROWS UNBOUNDED PRECEDING)""", "cumulative_return")
check("b9_bucket_stats", lambda t: BT.bucket_stats(_trades(t)), f"WITH {_SIMM}\nFINAL SELECT bucket, avg(net_return) AS avg_return, avg(CAST(net_return > 0 AS INT)) AS win_rate FROM trades GROUP BY 1", "avg_return win_rate")
check("b9_exit_counts", lambda t: BT.exit_counts(_trades(t)), f"WITH {_SIMM}\nFINAL SELECT exit_reason, count(*) AS trades FROM trades GROUP BY 1")
_HIST = """SELECT CAST(least(coalesce(floor((x - lo) / ((hi - lo) / {b})), 0), {b} - 1) AS BIGINT) AS bin, count(*) AS trades
  FROM (SELECT {c} AS x FROM trades), (SELECT min({c}) AS lo, max({c}) AS hi FROM trades) GROUP BY 1"""
check("b9_return_histogram", lambda t: BT.report(_trades(t))["returns"], f"WITH {_SIMM}\nFINAL " + _HIST.format(b=50, c="net_return"))
check("b9_drawdown_histogram", lambda t: BT.report(_trades(t))["drawdowns"], f"WITH {_SIMM}\nFINAL " + _HIST.format(b=30, c="max_drawdown"))
