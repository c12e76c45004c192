"""Row filters of the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions.keys import is_buy
from tradeweft.functions.market import is_quote, list_rank, usd_volume


def block_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("block_number").between(first, last))


def retain(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows not older than ``days`` before ``now``."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAY"))


def priceable_evm(usdc: str, ref_tokens: list[str]) -> Column:
    """Swaps that can be priced: B is a reference token, amounts are non-zero and of
    opposite sign, and a USDC leg is between 0.1 and 10,000."""
    a, b = F.col("amount_a"), F.col("amount_b")
    size_ok = (F.col("token_b") != usdc) | F.abs(b).between(0.1, 10_000.0)
    return (F.col("token_b").isin(ref_tokens) & (a != 0) & (b != 0) & ((a < 0) != (b < 0)) & size_ok)


def positionable(quotes: list[str] | None = None) -> Column:
    """Swaps that move a position: B is a quote token and both amounts are non-zero."""
    return (is_quote(F.col("token_b"), quotes)
            & (F.abs(F.col("amount_a")) > 0) & (F.abs(F.col("amount_b")) > 0))


def filter_pairs(df: DataFrame, tokens: list[str]) -> DataFrame:
    return df.filter(F.col("token_a").isin(tokens) & F.col("token_b").isin(tokens))


def drop_accounts(df: DataFrame, keys: list[str] | None = None,
                  column: str = "account_keys") -> DataFrame:
    """Drop swaps whose transaction names one of ``keys`` among its accounts."""
    banned = F.array(*[F.lit(k) for k in (keys or K.EXCLUDED_ROUTERS)])
    return df.filter(~F.coalesce(F.arrays_overlap(F.col(column), banned), F.lit(False)))


def quality_filter(df: DataFrame, max_slippage: float = 10.0, min_usd: float = 0.01) -> DataFrame:
    """Unknown slippage counts as 0."""
    return df.filter((F.coalesce(F.col("slippage_pct"), F.lit(0.0)) < max_slippage)
                     & (usd_volume() >= min_usd)
                     & (F.col("amount_a") != 0) & (F.col("amount_b") != 0))


def min_usd(df: DataFrame, usd: float = 1.0) -> DataFrame:
    return df.filter(F.abs(F.col("amount_a") * F.col("token_a_usdc_price")) >= usd)


def between_times(df: DataFrame, start, end) -> DataFrame:
    """Inclusive time bounds. On a table partitioned by ``yyyymm`` the bounds also prune
    partitions."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    out = df.filter(F.col("timestamp").between(lo, hi))
    if "yyyymm" in df.columns:
        ym = lambda t: F.year(t) * 100 + F.month(t)
        out = out.filter(F.col("yyyymm").between(ym(lo), ym(hi)))
    return out


def buy_signals(swaps: DataFrame, start, end, quotes: list[str] | None = None,
                min_usd: float = 1000.0, breakout_usd: float = 10_000.0, buy_sign: int = 1,
                limit: int | None = None) -> DataFrame:
    """Large buys against a quote token, in time order."""
    size = usd_volume()
    hits = between_times(swaps, start, end).filter(
        is_quote(F.col("token_b"), quotes) & (size >= min_usd) & (size > breakout_usd)
        & (F.col("token_a_usdc_price") > 0) & is_buy(F.col("amount_a"), buy_sign))
    out = hits.select("timestamp", F.col("token_a").alias("token"), F.col("pool_address").alias("pool"),
                      "dex", F.col("token_a_usdc_price").alias("entry_price"), size.alias("size_usdc"))
    if limit is not None:
        return out.orderBy("timestamp", "token", "pool").limit(limit)
    return out


def volume_breakouts(swaps: DataFrame, start, end, quotes: list[str] | None = None,
                     min_usd: float = 1000.0) -> DataFrame:
    """The simpler signal: any trade above ``min_usd`` against a quote token."""
    size = usd_volume()
    return between_times(swaps, start, end).filter(is_quote(F.col("token_b"), quotes) & (size > min_usd)).select(
        "timestamp", F.col("token_a").alias("token"), F.col("pool_address").alias("pool"), "dex",
        F.col("token_a_usdc_price").alias("entry_price"), size.alias("size_usdc"))


# The columns of a swap that change sides together.
_SIDE = ("token_{}", "amount_{}", "amount_{}_raw", "amount_{}_text", "token_{}_symbol", "token_{}_decimals",
         "token_{}_creation_date", "token_{}_issuance", "pool_token_{}_reserve", "token_{}_usdc_price")


def _swap_sides(df: DataFrame, switch: Column) -> DataFrame:
    cols = {}
    for pattern in _SIDE:
        a, b = pattern.format("a"), pattern.format("b")
        if a in df.columns and b in df.columns:
            cols[a] = F.when(switch, F.col(b)).otherwise(F.col(a))
            cols[b] = F.when(switch, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"a_b_swapped": switch}).withColumns(cols) if "a_b_swapped" not in df.columns \
        else df.withColumns(cols)


def orient_pair_evm(df: DataFrame, ref_tokens: list[str]) -> DataFrame:
    """Make the more fundamental token B; ``a_b_swapped`` marks changed rows."""
    switch = list_rank(F.col("token_a"), ref_tokens) < list_rank(F.col("token_b"), ref_tokens)
    return _swap_sides(df, switch)


def orient_pair_quote(df: DataFrame, quotes: list[str] | None = None) -> DataFrame:
    """Make the better quote token B; equal ranks sort by mint in Unicode collation."""
    quotes = list(quotes or K.QUOTE_TOKENS)
    ra, rb = list_rank(F.col("token_a"), quotes), list_rank(F.col("token_b"), quotes)
    tie = F.collate(F.col("token_a"), "UNICODE") > F.collate(F.col("token_b"), "UNICODE")
    return _swap_sides(df, (ra < rb) | ((ra == rb) & tie))
