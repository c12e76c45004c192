"""All roll-ups of a swap table, to rebuild them from the raw rows, and SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tradeweft import constants as K
from tradeweft.operators import candles as C
from tradeweft.operators.movers import daily_movers, tokens_by_creation
from tradeweft.operators.pools import last_prices, pool_stats_1h


def rebuild(swaps: DataFrame, buy_sign: int = 1, quotes: list[str] | None = None,
            order: Column | None = None) -> dict[str, DataFrame]:
    """Every roll-up as a lazy frame by name."""
    return {
        "candles_1m": C.candles(swaps, "1 minute", buy_sign, order=order),
        "candles_1m_1usd": C.candles(swaps, "1 minute", buy_sign, min_usd=1.0, order=order),
        "candles_10s": C.candles10s(swaps, order=order),
        "token_swap_counts": C.token_swap_counts(swaps),
        "pool_stats_1h": pool_stats_1h(swaps, quotes),
        "last_prices": last_prices(swaps, quotes, order),
        "daily_movers": daily_movers(swaps, quotes, order),
        "tokens_by_creation": tokens_by_creation(swaps),
    }


def write_all(rollups: dict[str, DataFrame], folder: str) -> None:
    """Write the roll-ups, replacing what was there."""
    for name, df in rollups.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def with_quote_function(spark: SparkSession, quotes: list[str] | None = None) -> SparkSession:
    """Register ``allowed_quote_tokens()`` for SQL users."""
    items = ", ".join(f"'{q}'" for q in (quotes or K.QUOTE_TOKENS))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION allowed_quote_tokens() RETURNS ARRAY<STRING> RETURN array({items})")
    return spark
