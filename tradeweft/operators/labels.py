"""Training rows and labels. Windows are per signal: at most 24 hours of candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.functions.market import horizon_of
from tradeweft.functions.num import net_return
from tradeweft.functions.time import bucket


def signal_windows(signals: DataFrame, candles: DataFrame, horizon: Column | None = None,
                   ts: str = "bucket_ts") -> DataFrame:
    """Each signal with the candles in ``[entry, entry + horizon]`` of its token and pool.

    A range join as an equi-join on (token, pool, hour): a signal is repeated for the hours
    of its horizon (at most 25), a candle is in one hour. A pool-hour has at most 360
    candles, and AQE splits a pool-hour with many signals on the signal side.

    ``signals``: signal_id, token, pool, timestamp, bucket.
    """
    hours = horizon_of(F.col("bucket")) if horizon is None else horizon
    s = signals.withColumn("_end", F.timestamp_seconds(
        F.unix_seconds("timestamp") + hours.cast("long") * 3600
    ) + F.make_dt_interval(secs=(F.pmod(F.unix_micros("timestamp"), F.lit(1_000_000)) / 1_000_000)))
    first = bucket(F.col("timestamp"), "1 hour")
    s = s.withColumn("_h", F.explode(F.sequence(first, bucket(F.col("_end"), "1 hour"),
                                                F.expr("INTERVAL 1 HOUR"))))
    c = candles.withColumn("_h", bucket(F.col(ts), "1 hour"))
    clash = [x for x in c.columns if x in s.columns and x not in ("token", "pool", "_h")]
    if clash:
        raise ValueError(f"rename candle columns {clash}")
    return s.join(c, ["token", "pool", "_h"]).filter(
        (F.col(ts) >= F.col("timestamp")) & (F.col(ts) <= F.col("_end"))).drop("_h", "_end")


def _back(by: Sequence[str], ts: str):
    """Rows from the end: a suffix frame as a running frame in descending order."""
    return Window.partitionBy(*by).orderBy(F.col(ts).desc())


def peak_drawdown(c: DataFrame, price: str = "close_price", by: Sequence[str] = ("token", "pool"),
                  ts: str = "bucket_ts") -> DataFrame:
    """Running maximum price and the drawdown from it."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("peak", F.max(price).over(w)).withColumn(
        "drawdown", F.try_divide(F.col("peak") - F.col(price), F.col("peak")))


def future_max(c: DataFrame, price: str = "close_price", by: Sequence[str] = ("token", "pool"),
               ts: str = "bucket_ts") -> DataFrame:
    """Highest price from this row on."""
    w = _back(by, ts).rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("future_max", F.max(price).over(w))


def training_set(signals: DataFrame, features: DataFrame, ts: str = "bucket_ts",
                 horizon: Column | None = None) -> DataFrame:
    """One row per (signal, candle after entry) with net return and upside left.

    ``signals``: signal_id, token, pool, timestamp, entry_price, size_usdc, bucket, dex_fee,
    slippage. ``features``: token, pool, bucket_ts, price_close_price and any others.
    """
    rows = signal_windows(signals, features, horizon, ts)
    rows = future_max(rows, "price_close_price", ["signal_id"], ts)
    c = F.col
    now = net_return(c("price_close_price"), c("entry_price"), c("dex_fee"), c("slippage"))
    best = net_return(c("future_max"), c("entry_price"), c("dex_fee"), c("slippage"))
    minutes = (F.unix_micros(ts) - F.unix_micros("timestamp")) / 60e6
    return rows.withColumns({
        "current_price": c("price_close_price"), "net_return_current": now, "upside_left": best - now,
        "minutes_since_entry": minutes}).withColumnRenamed("timestamp", "entry_time") \
        .withColumnRenamed(ts, "timestamp").withColumnRenamed("size_usdc", "trade_size_usdc").drop("future_max")


def drawdown_labels(df: DataFrame, threshold: float = 0.05, by: Sequence[str] = ("signal_id",),
                    ts: str = "timestamp", ret: str = "net_return_current") -> DataFrame:
    """1 where the net return still falls by more than ``threshold`` from a later peak."""
    w = _back(by, ts)
    later_low = F.min(ret).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_fall", F.col(ret) - later_low)
    worst = F.max("_fall").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("max_future_drawdown", F.greatest(F.coalesce(worst, F.lit(0.0)), F.lit(0.0))) \
        .withColumn("drawdown_label", (F.col("max_future_drawdown") > threshold).cast("int")).drop("_fall")


def hindsight_labels(df: DataFrame, lam: float = 0.01, mu: float = 0.1, by: Sequence[str] = ("signal_id",),
                     ts: str = "timestamp") -> DataFrame:
    """Best exit per trade in hindsight: utility = return - lam * hours - mu * max drawdown."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    out = df.withColumn("_peak", F.greatest(F.max("current_price").over(w), c("entry_price")))
    out = out.withColumn("_dd", F.max(F.try_divide(c("_peak") - c("current_price"), c("_peak"))).over(w))
    out = out.withColumn("utility", c("net_return_current") - lam * c("minutes_since_entry") / 60 - mu * c("_dd"))
    return out.groupBy(*by).agg(
        F.max_by(ts, F.struct("utility", -F.unix_micros(ts))).alias("best_exit"),
        F.max("utility").alias("best_utility"))


def time_split(df: DataFrame, cut, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    at = F.lit(cut).cast("timestamp")
    return df.filter(F.col(ts) < at), df.filter(F.col(ts) >= at)
