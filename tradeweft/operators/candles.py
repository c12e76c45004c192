"""Candles and other bucketed roll-ups.

Open and close are ``min_by`` / ``max_by`` on a packed order key: every buffer has a fixed
width, so Spark aggregates by hash with a partial step before the shuffle, and a hot pool
sends one row per task and bucket. The keys stay in the result (``open_key``,
``close_key``): a candle table can be merged with another one or rolled up again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions import keys as OK
from tradeweft.functions.market import pool_tvl, usd_volume
from tradeweft.functions.num import safe_div
from tradeweft.functions.time import bucket
from tradeweft.operators.filters import min_usd as _min_usd
from tradeweft.operators.filters import quality_filter

_SUMS = ("volume_usdc", "swap_count", "buy_count", "sell_count", "buy_volume_usdc", "sell_volume_usdc")


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def candles(swaps: DataFrame, interval: str = "1 minute", buy_sign: int = -1,
            min_usd: float | None = None, order: Column | None = None) -> DataFrame:
    """OHLC and volumes per (pool, token A, bucket) of rows with a price."""
    rows = swaps.filter(F.col("token_a_usdc_price") > 0)
    if min_usd is not None:
        rows = _min_usd(rows, min_usd)
    price, sign = F.col("token_a_usdc_price"), F.col("sign")
    key = OK.schema_order_key(swaps) if order is None else order
    buy, sell = OK.is_buy(F.col("amount_a"), buy_sign), OK.is_sell(F.col("amount_a"), buy_sign)
    value = F.abs(F.col("amount_a") * price) * sign
    rows = rows.select(
        F.col("pool_address"), F.col("token_a").alias("token"),
        bucket(F.col("timestamp"), interval).alias("bucket_ts"), price.alias("_price"),
        key.alias("_key"), sign.alias("_sign"), (usd_volume() * sign).alias("_volume"),
        buy.alias("_buy"), sell.alias("_sell"), value.alias("_value"))
    return rows.groupBy("pool_address", "token", "bucket_ts").agg(
        F.sum("_volume").alias("volume_usdc"),
        _long(F.sum("_sign")).alias("swap_count"),
        _long(F.sum(F.when(F.col("_buy"), F.col("_sign")))).alias("buy_count"),
        _long(F.sum(F.when(F.col("_sell"), F.col("_sign")))).alias("sell_count"),
        F.sum(F.when(F.col("_buy"), F.col("_value")).otherwise(0.0)).alias("buy_volume_usdc"),
        F.sum(F.when(F.col("_sell"), F.col("_value")).otherwise(0.0)).alias("sell_volume_usdc"),
        F.min_by("_price", "_key").alias("open"), F.max("_price").alias("high"),
        F.min("_price").alias("low"), F.max_by("_price", "_key").alias("close"),
        F.min("_key").alias("open_key"), F.max("_key").alias("close_key"))


def rollup_candles(c: DataFrame, interval: str, by: Sequence[str] = ("pool_address", "token")) -> DataFrame:
    """Candles of a multiple of the interval, with ``rise``. Merges partial candles too."""
    out = c.groupBy(*by, bucket(F.col("bucket_ts"), interval).alias("bucket_ts_")).agg(
        *[F.sum(s).alias(s) for s in _SUMS],
        F.min_by("open", "open_key").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "close_key").alias("close"),
        F.min("open_key").alias("open_key"), F.max("close_key").alias("close_key"))
    return out.withColumnRenamed("bucket_ts_", "bucket_ts").withColumn(
        "rise", safe_div(F.col("close") - F.col("open"), F.col("open")))


def candle_check(swaps: DataFrame, pool: str, start, interval: str = "5 minutes",
                 low: float = 0.1, high: float = 10_000.0) -> DataFrame:
    """One candle of one pool straight from the swaps, for trades of bounded size in B."""
    rows = swaps.filter((F.col("pool_address") == pool)
                        & (bucket(F.col("timestamp"), interval) == F.lit(start).cast("timestamp"))
                        & F.abs(F.col("amount_b")).between(low, high))
    key, p = OK.schema_order_key(swaps), F.col("token_a_usdc_price")
    return rows.agg(F.sum(usd_volume() * F.col("sign")).alias("vol"), F.count(F.lit(1)).alias("count"),
                    F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"),
                    F.max_by(p, key).alias("close"))


def candles10s(swaps: DataFrame, interval: str = "10 seconds", order: Column | None = None) -> DataFrame:
    """OHLC of both tokens per (pool, pair, dex, bucket) of quality trades.

    Average slippage is kept as sum and count, so the table can be merged.
    """
    key = OK.schema_order_key(swaps) if order is None else order
    rows = quality_filter(swaps).select(
        "pool_address", "token_a", "token_b", "dex", bucket(F.col("timestamp"), interval).alias("bucket_ts"),
        F.col("token_a_usdc_price").alias("_pa"), F.col("token_b_usdc_price").alias("_pb"),
        key.alias("_key"), "sign", (usd_volume() * F.col("sign")).alias("_volume"),
        F.coalesce(F.col("slippage_pct"), F.lit(0.0)).alias("_slip"), pool_tvl().alias("_tvl"))
    ohlc = []
    for side, c in (("a", "_pa"), ("b", "_pb")):
        ohlc += [F.min_by(c, "_key").alias(f"open_token_{side}_usdc"),
                 F.max(c).alias(f"high_token_{side}_usdc"), F.min(c).alias(f"low_token_{side}_usdc"),
                 F.max_by(c, "_key").alias(f"close_token_{side}_usdc")]
    out = rows.groupBy("pool_address", "token_a", "token_b", "dex", "bucket_ts").agg(
        *ohlc, F.sum("sign").cast("long").alias("swap_count"), F.sum("_volume").alias("volume_usdc"),
        F.sum("_slip").alias("slippage_sum"), F.count("_slip").alias("slippage_count"),
        F.max("_tvl").alias("max_pool_tvl_usdc"), F.min("_key").alias("open_key"),
        F.max("_key").alias("close_key"))
    return out.withColumn("avg_slippage_pct", safe_div(F.col("slippage_sum"), F.col("slippage_count")))


def both_tokens(swaps: DataFrame) -> DataFrame:
    """One row per swap and token side."""
    return swaps.select(F.explode(F.array("token_a", "token_b")).alias("token"), "sign")


def token_swap_counts(swaps: DataFrame) -> DataFrame:
    return both_tokens(swaps).groupBy("token").agg(F.sum("sign").cast("long").alias("swap_count"))


def buyers_sellers(swaps: DataFrame, pool: str, now: Column, buy_sign: int = -1,
                   approximate: bool = False) -> DataFrame:
    """Distinct buyers and sellers of a pool in the 24 hours before ``now``."""
    rows = swaps.filter((F.col("pool_address") == pool)
                        & (F.col("timestamp") >= now - F.expr("INTERVAL 24 HOUR")))
    a = F.col("amount_a")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count(F.when(OK.is_buy(a, buy_sign), F.col("account"))).alias("buyers"),
                    count(F.when(OK.is_sell(a, buy_sign), F.col("account"))).alias("sellers"))


def trader_sketches(swaps: DataFrame, interval: str = "1 hour", buy_sign: int = -1, lg_k: int = 12) -> DataFrame:
    """Sketches of the buyers and sellers per (pool, bucket), a column that stored roll-ups can merge.

    The standard error of an estimate is about 1.04 / sqrt(2 ** lg_k), 1.6 % by default, whatever is merged;
    small counts are nearly exact. Rows without an account are no traders.
    """
    a, who = F.col("amount_a"), F.col("account")
    return swaps.groupBy("pool_address", bucket(F.col("timestamp"), interval).alias("bucket_ts")).agg(
        F.hll_sketch_agg(F.when(OK.is_buy(a, buy_sign), who), lg_k).alias("buyers_sketch"),
        F.hll_sketch_agg(F.when(OK.is_sell(a, buy_sign), who), lg_k).alias("sellers_sketch"))


def merged_traders(sketches: DataFrame, interval: str) -> DataFrame:
    """Sketches of longer buckets from shorter ones, with the estimated numbers of traders."""
    out = sketches.groupBy("pool_address", bucket(F.col("bucket_ts"), interval).alias("_to")).agg(
        F.hll_union_agg("buyers_sketch").alias("buyers_sketch"), F.hll_union_agg("sellers_sketch").alias("sellers_sketch"))
    return out.withColumnRenamed("_to", "bucket_ts").withColumns({
        "approx_buyers": F.hll_sketch_estimate("buyers_sketch"), "approx_sellers": F.hll_sketch_estimate("sellers_sketch")})


def swaps_per_bucket(swaps: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Swaps with the token as A, per (token, bucket)."""
    return swaps.groupBy(F.col("token_a").alias("token"),
                         bucket(F.col("timestamp"), interval).alias("bucket_ts")) \
        .agg(F.count(F.lit(1)).alias("swap_count"))
