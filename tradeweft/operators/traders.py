"""Trader statistics and leaderboards.

Each level aggregates before it joins: swaps -> (account, token) -> account. Map-side
partial aggregation keeps a hot account at one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions.keys import is_buy, is_sell
from tradeweft.functions.market import is_quote, usd_volume
from tradeweft.functions.num import safe_div
from tradeweft.functions.time import boundary_diff, bucket
from tradeweft.operators.filters import between_times


def _sum_if(value: Column, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def _token_stats(rows: DataFrame, buy_sign: int) -> DataFrame:
    a, sign = F.col("amount_a"), F.col("sign")
    buy, sell = is_buy(a, buy_sign), is_sell(a, buy_sign)
    out = rows.groupBy("account", F.col("token_a").alias("token")).agg(
        _sum_if(sign, sell).cast("long").alias("sells"), _sum_if(sign, buy).cast("long").alias("buys"),
        _sum_if(F.abs(a) * sign, sell).alias("sold_amount"),
        _sum_if(F.abs(a) * sign, buy).alias("bought_amount"),
        F.max("token_a_wins").alias("tx_wins"), F.max("token_a_loses").alias("tx_loses"),
        F.sum(F.col("token_a_profit_usdc") * sign).alias("total_profit_usdc"))
    return out.withColumn("sold_to_bought_ratio", safe_div(F.col("sold_amount"), F.col("bought_amount")))


def _priced(swaps: DataFrame, start, end) -> DataFrame:
    return between_times(swaps, start, end).filter(
        (F.col("token_a_usdc_price") != 0) & (F.col("token_b_usdc_price") != 0))


def _quoted(swaps: DataFrame, start, end, quotes) -> DataFrame:
    return between_times(swaps, start, end).filter(is_quote(F.col("token_b"), quotes))


def trader_token_stats_evm(swaps: DataFrame, start, end, buy_sign: int = -1) -> DataFrame:
    """Per (account, token): trades, amounts, ratio, wins, losses, profit of priced swaps."""
    return _token_stats(_priced(swaps, start, end), buy_sign)


def trader_token_stats(swaps: DataFrame, start, end, quotes: list[str] | None = None,
                       buy_sign: int = 1) -> DataFrame:
    """The same for swaps against a quote token."""
    return _token_stats(_quoted(swaps, start, end, quotes), buy_sign)


def _win_loss(stats: DataFrame) -> DataFrame:
    return stats.groupBy("account").agg(
        F.sum("tx_wins").alias("tx_wins_total"), F.sum("tx_loses").alias("tx_loses_total"),
        F.count_if(F.col("total_profit_usdc") > 0).alias("token_wins"),
        F.count_if(F.col("total_profit_usdc") < 0).alias("token_loses"),
        F.count(F.lit(1)).alias("distinct_tokens"))


def _account_totals(rows: DataFrame, buy_sign: int) -> DataFrame:
    """Account totals, folded from (account, token) rows so that the distinct count of
    tokens is a plain count."""
    a, sign = F.col("amount_a"), F.col("sign")
    per_token = rows.groupBy("account", "token_a").agg(
        F.sum(sign).alias("_n"), F.count(F.lit(1)).alias("_rows"),
        F.sum(F.abs(a) * F.col("token_a_usdc_price") * sign).alias("_traded"),
        _sum_if(sign, is_buy(a, buy_sign)).alias("_buys"), _sum_if(sign, is_sell(a, buy_sign)).alias("_sells"),
        F.sum(F.col("token_a_cost_usdc") * sign).alias("_cost"),
        F.sum(F.col("token_a_profit_usdc") * sign).alias("_profit"),
        F.sum(F.col("token_a_wins") * sign).alias("_wins"),
        F.sum(F.col("token_a_loses") * sign).alias("_loses"),
        F.max("token_a_wins").alias("_max_wins"), F.max("token_a_loses").alias("_max_loses"),
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    return per_token.groupBy("account").agg(
        F.sum("_n").cast("long").alias("tx_count"), safe_div(F.sum("_traded"), F.sum("_rows")).alias("avg_trade_usdc"),
        F.sum("_buys").cast("long").alias("buys"), F.sum("_sells").cast("long").alias("sells"),
        F.count(F.lit(1)).alias("distinct_tokens"), F.sum("_cost").alias("total_cost_usdc"),
        F.sum("_profit").alias("total_profit_usdc"), F.sum("_wins").cast("long").alias("tx_wins"),
        F.sum("_loses").cast("long").alias("tx_loses"),
        F.sum("_max_wins").cast("long").alias("tx_wins_total"),
        F.sum("_max_loses").cast("long").alias("tx_loses_total"),
        F.count_if(F.col("_profit") > 0).alias("token_wins"),
        F.count_if(F.col("_profit") < 0).alias("token_loses"),
        F.min("_first").alias("first_tx"), F.max("_last").alias("last_tx"))


def _ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "tx_win_ratio": safe_div(c("tx_wins"), c("tx_wins") + c("tx_loses")),
        "token_win_ratio": safe_div(c("token_wins"), c("token_wins") + c("token_loses")),
        "pnl_percent": safe_div(c("total_profit_usdc"), c("total_cost_usdc")) * 100})


def top_traders_evm(swaps: DataFrame, start, end, buy_sign: int = -1) -> DataFrame:
    """Account leaderboard. ``tx_wins`` sums the running counters of the rows;
    ``tx_wins_total`` is the number of wins.

    The per-token win/loss table has the same input and grouping as the totals, so it is
    one aggregation and no join.
    """
    out = _ratios(_account_totals(_priced(swaps, start, end), buy_sign))
    hours = boundary_diff("hour", F.col("first_tx"), F.col("last_tx"))
    return out.withColumn("tx_per_hour", safe_div(F.col("tx_count"), hours))


def holding_times(swaps: DataFrame, buy_sign: int = 1) -> DataFrame:
    """Average seconds from first buy to first / last sell, per account.

    A token counts when it was bought and first sold not before the first buy.
    """
    a, ts = F.col("amount_a"), F.col("timestamp")
    buy, sell = is_buy(a, buy_sign), is_sell(a, buy_sign)
    per_token = swaps.groupBy("account", "token_a").agg(
        F.min(F.when(buy, ts)).alias("_buy"), F.min(F.when(sell, ts)).alias("_sell"),
        F.max(F.when(sell, ts)).alias("_last"))
    kept = per_token.filter(F.col("_sell") >= F.col("_buy"))
    s = F.unix_seconds
    return kept.groupBy("account").agg(
        F.count(F.lit(1)).alias("unique_tokens"),
        F.avg(s("_sell") - s("_buy")).alias("avg_holding_time_to_first_sell"),
        F.avg(s("_last") - s("_buy")).alias("avg_holding_time_to_last_sell"))


def top_traders(swaps: DataFrame, start, end, quotes: list[str] | None = None,
                buy_sign: int = 1) -> DataFrame:
    """Account leaderboard with holding times; only accounts that have them."""
    rows = _quoted(swaps, start, end, quotes)
    out = _ratios(_account_totals(rows, buy_sign)).drop("avg_trade_usdc")
    return out.join(holding_times(rows, buy_sign).drop("unique_tokens"), "account")


def ranked(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last())


def top_k(df: DataFrame, condition: Column, column: str, k: int, tie: str = "account") -> DataFrame:
    """Best ``k`` rows; Spark keeps only ``k`` per task (TakeOrdered)."""
    return df.filter(condition).orderBy(F.col(column).desc_nulls_last(), tie).limit(k)


def smart_traders(top: DataFrame, n: int = 100, ratio: float = 0.6) -> DataFrame:
    return top_k(top, (F.col("pnl_percent") > 0) & (F.col("token_win_ratio") > ratio),
                 "pnl_percent", n).select("account")


def smart_money_trades(swaps: DataFrame, traders: DataFrame) -> DataFrame:
    """Swaps of the given traders. Spark broadcasts the list when it is small."""
    return swaps.join(traders.select("account"), "account", "left_semi")


def smart_flows(swaps: DataFrame, traders: DataFrame, buy_sign: int = 1,
                interval: str = "1 minute") -> DataFrame:
    """Buy and sell volume and count of smart traders per (token, pool, minute)."""
    a = F.col("amount_a")
    value = F.abs(a * F.col("token_a_usdc_price"))
    buy, sell = is_buy(a, buy_sign), is_sell(a, buy_sign)
    return smart_money_trades(swaps, traders).groupBy(
        F.col("token_a").alias("token"), F.col("pool_address").alias("pool"),
        bucket(F.col("timestamp"), interval).alias("minute_ts")).agg(
        F.sum(F.when(buy, value).otherwise(0.0)).alias("smart_buy_volume"),
        F.sum(F.when(sell, value).otherwise(0.0)).alias("smart_sell_volume"),
        F.count_if(buy).alias("smart_buy_count"), F.count_if(sell).alias("smart_sell_count"))


def order_flow(swaps: DataFrame, buy_sign: int = 1, interval: str = "1 minute") -> DataFrame:
    """Buy and sell flow, slippage and liquidity per (token, pool, minute)."""
    from tradeweft.functions.market import pool_tvl
    a, value, slip = F.col("amount_a"), usd_volume(), F.abs(F.coalesce(F.col("slippage_pct"), F.lit(0.0)))
    buy, sell = is_buy(a, buy_sign), is_sell(a, buy_sign)
    return swaps.groupBy(
        F.col("token_a").alias("token"), F.col("pool_address").alias("pool"),
        bucket(F.col("timestamp"), interval).alias("minute_ts")).agg(
        F.sum(F.when(buy, value).otherwise(0.0)).alias("buy_volume_usdc"),
        F.sum(F.when(sell, value).otherwise(0.0)).alias("sell_volume_usdc"),
        F.count_if(buy).alias("buy_count"), F.count_if(sell).alias("sell_count"),
        F.avg(slip).alias("avg_slippage"), F.percentile(slip, 0.8).alias("p80_slippage"),
        F.avg(pool_tvl()).alias("avg_tvl"))
