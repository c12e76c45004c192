"""Daily movers and token dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions import keys as OK
from tradeweft.functions.market import is_quote, usd_volume
from tradeweft.functions.num import safe_div
from tradeweft.functions.time import bucket


def daily_movers(swaps: DataFrame, quotes: list[str] | None = None,
                 order: Column | None = None) -> DataFrame:
    """Open, close and volume per (day, token, pool) of quality trades."""
    key = OK.schema_order_key(swaps) if order is None else order
    rows = swaps.filter(
        (F.col("token_a_usdc_price") > 0) & is_quote(F.col("token_b"), quotes)
        & (F.coalesce(F.col("slippage_pct"), F.lit(0.0)) < 10) & (usd_volume() >= 0.01)
    ).select(bucket(F.col("timestamp"), "1 day").alias("day"), F.col("token_a").alias("token_address"),
             "pool_address", "token_a_symbol", "token_a_creation_date", "dex",
             F.col("token_a_usdc_price").alias("_p"), key.alias("_key"),
             (usd_volume() * F.col("sign")).alias("_v"))
    return rows.groupBy("day", "token_address", "pool_address").agg(
        F.min("token_a_symbol").alias("token_symbol"), F.min("token_a_creation_date").alias("token_created_at"),
        F.min("dex").alias("dex"), F.min_by("_p", "_key").alias("open_price_usdc"),
        F.max_by("_p", "_key").alias("close_price_usdc"), F.sum("_v").alias("volume_usdc"),
        F.min("_key").alias("open_key"), F.max("_key").alias("close_key"))


def mover_bounds(now: Column, offset_days: int, period_days: int) -> tuple[Column, Column]:
    day = lambda t: bucket(t, "1 day")
    return (day(now - F.expr(f"INTERVAL {offset_days + period_days} DAY")),
            day(now - F.expr(f"INTERVAL {offset_days} DAY")))


def top_movers(movers: DataFrame, stats: DataFrame, now: Column, offset_days: int,
               period_days: int) -> DataFrame:
    """Growth of each token in its best pool over ``period_days + 1`` days."""
    from tradeweft.operators.pools import best_quote_pools
    start, end = mover_bounds(now, offset_days, period_days)
    best = best_quote_pools(stats, start, end).select(
        F.col("token_a").alias("token_address"), "pool_address")
    days = movers.filter(F.col("day").between(start, end))
    # Fold the days of a pool first: the join then sees one row per (token, pool).
    folded = days.groupBy("token_address", "pool_address").agg(
        F.min("dex").alias("dex"), F.min("token_symbol").alias("token_symbol"),
        F.min("token_created_at").alias("_created"), F.sum("volume_usdc").alias("volume_usdc"),
        F.min_by("open_price_usdc", "open_key").alias("open_price_usdc"),
        F.max_by("close_price_usdc", "close_key").alias("close_price_usdc"))
    out = folded.join(best, ["token_address", "pool_address"])
    o, c = F.col("open_price_usdc"), F.col("close_price_usdc")
    return out.select(
        start.alias("start_date"), end.alias("end_date"), "token_address", "pool_address", "dex",
        "token_symbol", (F.unix_seconds(now) - F.unix_seconds("_created")).alias("age_sec"),
        "volume_usdc", o, c, (safe_div(c - o, o) * 100).alias("grow_pct"))


def tokens_by_creation(swaps: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per token: symbol and creation date of its first swap, and that swap's time."""
    key = OK.schema_order_key(swaps) if order is None else order
    return swaps.select(F.col("token_a").alias("token_address"), "token_a_symbol",
                        "token_a_creation_date", "timestamp", key.alias("_key")) \
        .groupBy("token_address").agg(
            F.min_by("token_a_symbol", "_key").alias("token_symbol"),
            F.min_by("token_a_creation_date", "_key").alias("creation_date"),
            F.min("timestamp").alias("first_swap_date"))
