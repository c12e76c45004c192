"""Market columns: volume, liquidity, fees, buckets, quote membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweft import constants as K


def usd_volume(amount: str = "amount_b", price: str = "token_b_usdc_price") -> Column:
    return F.abs(F.col(amount) * F.col(price))


def pool_tvl() -> Column:
    return (F.abs(F.col("pool_token_a_reserve") * F.col("token_a_usdc_price"))
            + F.abs(F.col("pool_token_b_reserve") * F.col("token_b_usdc_price")))


def is_quote(token: Column, quotes: list[str] | None = None) -> Column:
    return token.isin(list(quotes or K.QUOTE_TOKENS))


def list_rank(token: Column, ordered: list[str]) -> Column:
    """Position of ``token`` in a short ordered list; a large number when absent."""
    rank = F.lit(1_000_000_000)
    for i, t in reversed(list(enumerate(ordered))):
        rank = F.when(token == t, i).otherwise(rank)
    return rank


def dex_fee(dex: Column, default: float = 0.003, fees: dict[str, float] | None = None) -> Column:
    table = fees or K.DEX_FEES
    return reduce(lambda acc, kv: acc.when(F.lower(dex) == kv[0], kv[1]),
                  list(table.items())[1:],
                  F.when(F.lower(dex) == next(iter(table)), table[next(iter(table))])) \
        .otherwise(default)


def bucket_of(age_days: Column, tvl: Column) -> Column:
    """First liquidity bucket whose age and TVL bounds (both inclusive) hold."""
    value = F.coalesce(tvl, F.lit(0.0))
    expr = None
    for name, min_age, max_age, min_tvl, max_tvl in K.LIQUIDITY_BUCKETS:
        hit = age_days.between(min_age, max_age) & value.between(min_tvl, max_tvl)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("new_tokens")


def horizon_of(bucket: Column) -> Column:
    expr = None
    for name, hours in K.HORIZON_HOURS.items():
        expr = F.when(bucket == name, hours) if expr is None else expr.when(bucket == name, hours)
    return expr.otherwise(K.HORIZON_HOURS["established"])
