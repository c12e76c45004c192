"""Rolling features on candles and minute flows.

These windows are partitioned by (token, pool) over bucketed rows: at most 8,640 candles
(10 s) or 1,440 minutes a day per pool, whatever the number of trades. One sort per
(token, pool) serves all features of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.functions.market import bucket_of, dex_fee, pool_tvl, usd_volume
from tradeweft.functions.num import pct_change, safe_div
from tradeweft.functions.time import boundary_diff, bucket
from tradeweft.operators.ordered import CHUNK, asof_join, chunk, with_history
from tradeweft.operators.range_quantiles import range_quantiles
from tradeweft.operators.traders import order_flow, smart_flows

_BY = ("token", "pool")


def _win(ts: str, by: Sequence[str] = _BY):
    return Window.partitionBy(*by).orderBy(ts)


def _log_ratio(a: Column, b: Column) -> Column:
    ratio = safe_div(a, b)
    return F.when(ratio > 0, F.ln(ratio))


def log_returns(c: DataFrame, lags: Sequence[int] = (1, 18, 36, 180), ts: str = "bucket_ts") -> DataFrame:
    w, p = _win(ts), F.col("close_price")
    return c.withColumns({f"log_return_{k}": _log_ratio(p, F.lag(p, k).over(w)) for k in lags})


def rolling_vol(c: DataFrame, rows: Sequence[int] = (18, 36), ts: str = "bucket_ts") -> DataFrame:
    """Sample deviation of the one-step log return (``log_return_1``)."""
    w = _win(ts)
    return c.withColumns({f"volatility_{n}": F.stddev_samp("log_return_1").over(w.rowsBetween(1 - n, 0))
                          for n in rows})


def atr(c: DataFrame, rows: int = 20, ts: str = "bucket_ts") -> DataFrame:
    span = F.col("high_price") - F.col("low_price")
    return c.withColumn(f"atr_{rows}", F.avg(span).over(_win(ts).rowsBetween(1 - rows, 0)))


def volume_ratio(c: DataFrame, rows: int = 20, ts: str = "bucket_ts") -> DataFrame:
    mean = F.avg("volume_usdc").over(_win(ts).rowsBetween(1 - rows, 0))
    return c.withColumn(f"volume_sma_{rows}", mean).withColumn(
        "volume_ratio", safe_div(F.col("volume_usdc"), F.col(f"volume_sma_{rows}")))


def tvl_change(c: DataFrame, column: str = "max_pool_tvl_usdc", name: str = "tvl_change_pct",
               ts: str = "bucket_ts") -> DataFrame:
    return c.withColumn(name, pct_change(F.col(column), F.lag(column, 1).over(_win(ts))))


def slippage_trend(c: DataFrame, short: int = 12, long: int = 36, ts: str = "bucket_ts") -> DataFrame:
    w, s = _win(ts), F.col("avg_slippage_pct")
    return c.withColumns({f"slippage_sma_{short}": F.avg(s).over(w.rowsBetween(1 - short, 0)),
                          "slippage_spike": s > F.avg(s).over(w.rowsBetween(1 - long, 0))})


def warmup(c: DataFrame, minutes: int = 6, start: Column | None = None, ts: str = "bucket_ts") -> DataFrame:
    """Drop the first minutes: of the window that begins at ``start``, or of each pool."""
    first = F.min(ts).over(Window.partitionBy(*_BY)) if start is None else start
    return c.withColumn("_first", first).filter(
        F.col(ts) >= F.col("_first") + F.expr(f"INTERVAL {int(minutes)} MINUTE")).drop("_first")


def candle_prices(candles: DataFrame) -> DataFrame:
    """Column names of the feature functions from a two-token candle table."""
    return candles.select(
        F.col("token_a").alias("token"), F.col("pool_address").alias("pool"), "bucket_ts",
        F.col("close_token_a_usdc").alias("close_price"), F.col("open_token_a_usdc").alias("open_price"),
        F.col("high_token_a_usdc").alias("high_price"), F.col("low_token_a_usdc").alias("low_price"),
        "volume_usdc", "swap_count", "avg_slippage_pct", "max_pool_tvl_usdc")


def price_features(c: DataFrame) -> DataFrame:
    """All candle features: returns, volatility, range, volume, liquidity, slippage."""
    out = rolling_vol(log_returns(c))
    return slippage_trend(tvl_change(volume_ratio(atr(out))))


def smart_rolling(flows: DataFrame, rows: int = 10, ts: str = "minute_ts") -> DataFrame:
    w = _win(ts).rowsBetween(1 - rows, 0)
    buy, sell = F.col("smart_buy_volume"), F.col("smart_sell_volume")
    return flows.withColumns({
        "smart_sell_ratio": safe_div(sell, buy + sell),
        f"smart_sell_volume_{rows}min": F.sum(sell).over(w),
        f"smart_buy_volume_{rows}min": F.sum(buy).over(w)})


def smart_money_features(swaps: DataFrame, traders: DataFrame, buy_sign: int = 1,
                         interval: str = "1 minute") -> DataFrame:
    return smart_rolling(smart_flows(swaps, traders, buy_sign, interval))


def imbalance(flows: DataFrame, ts: str = "minute_ts") -> DataFrame:
    """Volume and count imbalance with rolling mean and deviation, slippage and TVL moves."""
    w, c = _win(ts), F.col
    out = flows.withColumns({
        "volume_imbalance": safe_div(c("buy_volume_usdc") - c("sell_volume_usdc"),
                                     c("buy_volume_usdc") + c("sell_volume_usdc")),
        "count_imbalance": safe_div(c("buy_count") - c("sell_count"), c("buy_count") + c("sell_count")),
        "slippage_increasing": c("avg_slippage") > F.lag("avg_slippage", 5).over(w),
        "tvl_change_1min": pct_change(c("avg_tvl"), F.lag("avg_tvl", 1).over(w))})
    return out.withColumns({
        "imbalance_5min_avg": F.avg("volume_imbalance").over(w.rowsBetween(-4, 0)),
        "imbalance_10min_std": F.stddev_samp("volume_imbalance").over(w.rowsBetween(-9, 0))})


def order_flow_features(swaps: DataFrame, buy_sign: int = 1, interval: str = "1 minute") -> DataFrame:
    return imbalance(order_flow(swaps, buy_sign, interval))


def token_age_tvl(signals: DataFrame, swaps: DataFrame) -> DataFrame:
    """Age in days of each signal's token and its average TVL in the hour before.

    ``signals``: signal_id, token, timestamp. Age comes from an as-of join. TVL sums are
    kept per (token, second) and met by an equi-join on hour buckets, two per signal.
    """
    rows = swaps.select(F.col("token_a").alias("token"), "timestamp", "token_a_creation_date",
                        pool_tvl().alias("_tvl"))
    dated = rows.groupBy("token", "timestamp").agg(
        F.max("token_a_creation_date").alias("_created"),
        F.sum(F.when(F.col("_tvl") > 0, F.col("_tvl"))).alias("_s"),
        F.count_if(F.col("_tvl") > 0).alias("_n"))
    aged = asof_join(signals, dated, on=["timestamp"], by=["token"], values=["_created"], strict=False)
    hour = bucket(F.col("timestamp"), "1 hour")
    left = signals.select("signal_id", "token", F.col("timestamp").alias("_at"),
                          F.explode(F.array(hour, hour - F.expr("INTERVAL 1 HOUR"))).alias("_h"))
    right = dated.select("token", F.col("timestamp").alias("_ts"), hour.alias("_h"), "_s", "_n")
    recent = left.join(right, ["token", "_h"]).filter(
        (F.col("_ts") <= F.col("_at")) & (F.col("_ts") >= F.col("_at") - F.expr("INTERVAL 1 HOUR")))
    tvl = recent.groupBy("signal_id").agg(safe_div(F.sum("_s"), F.sum("_n")).alias("avg_tvl_usdc"))
    return aged.join(tvl, "signal_id", "left").withColumn(
        "age_days", boundary_diff("day", F.col("_created"), F.col("timestamp"))).drop("_created")


def liquidity_bucket(signals: DataFrame, swaps: DataFrame) -> DataFrame:
    """Signals with age, TVL and liquidity bucket, for all signals at once."""
    out = token_age_tvl(signals, swaps)
    return out.withColumn("bucket", F.when(F.col("age_days").isNull(), "new_tokens").otherwise(
        bucket_of(F.col("age_days"), F.col("avg_tvl_usdc"))))


def slippage_profile(signals: DataFrame, swaps: DataFrame, low: float = 0.2, high: float = 0.5) -> DataFrame:
    """Slippage quantiles of trades of half to twice the size, in the hour before.

    ``signals``: signal_id, token, pool, timestamp, size_usdc. Signals of a pool-hour meet the trades of that
    hour and the one before as ranges over one sorted sequence, so the work of a pool-hour is in proportion to
    signals plus trades (times log^2), and its task holds two hours of one pool. Signals without such trades,
    or without a size, give no row; missing slippage counts as 0.
    """
    hour = lambda ts: F.unix_seconds(ts) - F.pmod(F.unix_seconds(ts), F.lit(3600))
    asked = signals.filter("token IS NOT NULL AND pool IS NOT NULL AND size_usdc IS NOT NULL").select(
        "signal_id", "token", "pool", hour(F.col("timestamp")).alias("_h"),
        F.unix_micros("timestamp").alias("_at"), F.col("size_usdc").cast("double").alias("_size"))
    own = hour(F.col("timestamp"))
    trades = swaps.select(
        F.col("token_a").alias("token"), F.col("pool_address").alias("pool"), F.unix_micros("timestamp").alias("_ts"),
        usd_volume().cast("double").alias("_usd"), F.abs(F.nanvl(F.coalesce(F.col("slippage_pct").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_slip"),
        F.explode(F.array(own, own + 3600)).alias("_h")).filter(F.col("_usd").isNotNull() & ~F.isnan("_usd"))
    by = ["token", "pool", "_h"]
    trades = trades.join(asked.select(*by).distinct(), by, "left_semi")  # trades that no signal asks for stay in the JVM

    def profile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, size = left["_at"].to_numpy(), left["_size"].to_numpy()
        got = range_quantiles(right["_ts"].to_numpy(), right["_usd"].to_numpy(), right["_slip"].to_numpy(),
                              (at - 3_600_000_000, at), (size * 0.5, size * 2.0), (low, high))
        out = pd.DataFrame({"signal_id": left["signal_id"], "slippage_low": got[:, 0], "slippage_high": got[:, 1]})
        return out[~np.isnan(got[:, 0])]

    kind = dict(signals.dtypes)["signal_id"]
    return asked.groupBy(*by).cogroup(trades.groupBy(*by)).applyInPandas(
        profile, f"signal_id {kind}, slippage_low double, slippage_high double")


def cost_model(signals: DataFrame, swaps: DataFrame, default: float = 0.01) -> DataFrame:
    """Signals with ``dex_fee`` and ``slippage`` as fractions; 1 % where no similar trade
    is known."""
    prof = slippage_profile(signals, swaps)
    lo, hi = F.col("slippage_low"), F.col("slippage_high")
    known = (lo != 0) & (hi != 0)
    return signals.join(prof, "signal_id", "left").withColumns({
        "dex_fee": dex_fee(F.col("dex")),
        "slippage": F.when(known, (lo + hi) / 2 / 100).otherwise(F.lit(default))}) \
        .drop("slippage_low", "slippage_high")


def merge_features(price: DataFrame, smart: DataFrame, flow: DataFrame, ts: str = "bucket_ts") -> DataFrame:
    """Price features with smart-money and flow features of the same moment, prefixed."""
    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        keys = {"token", "pool", "minute_ts", ts}
        return df.select("token", "pool", F.col("minute_ts").alias(ts),
                         *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])

    rest = [c for c in price.columns if c not in {"token", "pool", ts}]
    out = price.select("token", "pool", ts, *[F.col(c).alias(f"price_{c}") for c in rest])
    on = ["token", "pool", ts]
    return out.join(prefixed(smart, "smart_"), on, "left").join(prefixed(flow, "flow_"), on, "left")


def sequences(df: DataFrame, n: int, features: Sequence[str], target: str = "upside_left",
              by: Sequence[str] = _BY, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Windows of ``n`` rows per key with the target of the last row.

    Training rows per pool are not bounded by the clock (many signals meet one pool), so
    the frames are cut at chunk borders with ``n - 1`` rows of history.
    """
    ch = with_history(chunk(df, by, order), n - 1)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(1 - n, 0)
    out = ch.df.withColumn("sequence", F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w))
    return out.filter(~F.col("_halo") & (F.size("sequence") == n)).select(*by, *order, "sequence", target)
