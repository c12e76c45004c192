"""Candles and roll-ups of a swap stream.

Two ways. With a watermark, ``candles_stream`` emits each candle once its bucket is closed.
With ``merge_batches``, every micro-batch is aggregated to partial rows (one per key and
batch) and appended; a read merges the partials. Appending partials means a batch touches
only its own rows, however large the table is, and a hot key adds one row per batch.
A batch is written to its own folder, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradeweft.functions import keys as OK
from tradeweft.functions.market import usd_volume
from tradeweft.operators import candles as C
from tradeweft.operators.movers import daily_movers, tokens_by_creation
from tradeweft.operators.pools import last_prices, pool_stats_1h


def candles_stream(swaps: DataFrame, interval: str = "1 minute", buy_sign: int = -1,
                   lateness: str = "1 minute") -> DataFrame:
    """Closed candles of a stream (append mode)."""
    price, sign, key = F.col("token_a_usdc_price"), F.col("sign"), OK.packed_order_key()
    a = F.col("amount_a")
    value = F.abs(a * price) * sign
    buy, sell = OK.is_buy(a, buy_sign), OK.is_sell(a, buy_sign)
    out = swaps.filter(price > 0).withWatermark("timestamp", lateness).groupBy(
        "pool_address", F.col("token_a").alias("token"), F.window("timestamp", interval).alias("_w")).agg(
        F.sum(usd_volume() * sign).alias("volume_usdc"), F.sum(sign).cast("long").alias("swap_count"),
        F.sum(F.when(buy, sign).otherwise(0)).cast("long").alias("buy_count"),
        F.sum(F.when(sell, sign).otherwise(0)).cast("long").alias("sell_count"),
        F.sum(F.when(buy, value).otherwise(0.0)).alias("buy_volume_usdc"),
        F.sum(F.when(sell, value).otherwise(0.0)).alias("sell_volume_usdc"),
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), F.min(key).alias("open_key"), F.max(key).alias("close_key"))
    return out.select("pool_address", "token", F.col("_w.start").alias("bucket_ts"),
                      *[c for c in out.columns if c not in ("pool_address", "token", "_w")])


def _refold_swap_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("token").agg(F.sum("swap_count").alias("swap_count"))


def _refold_stats(p: DataFrame) -> DataFrame:
    return p.groupBy("hour_ts", "token_a", "token_b", "dex", "pool_address").agg(
        F.sum("volume_1h_usdc").alias("volume_1h_usdc"))


def _refold_last(p: DataFrame) -> DataFrame:
    return p.groupBy("token_a", "token_b", "pool_address").agg(
        F.max("swap_timestamp").alias("swap_timestamp"), F.max("order_key").alias("order_key_"),
        F.max_by("price_usdc", "order_key").alias("price_usdc")).withColumnRenamed("order_key_", "order_key")


def _refold_movers(p: DataFrame) -> DataFrame:
    return p.groupBy("day", "token_address", "pool_address").agg(
        F.min("token_symbol").alias("token_symbol"), F.min("token_created_at").alias("token_created_at"),
        F.min("dex").alias("dex"), F.min_by("open_price_usdc", "open_key").alias("open_price_usdc"),
        F.max_by("close_price_usdc", "close_key").alias("close_price_usdc"),
        F.sum("volume_usdc").alias("volume_usdc"),
        F.min("open_key").alias("open_key_"), F.max("close_key").alias("close_key_")) \
        .withColumnsRenamed({"open_key_": "open_key", "close_key_": "close_key"})


def _refold_tokens(p: DataFrame) -> DataFrame:
    return p.groupBy("token_address").agg(
        F.min_by("token_symbol", "first_swap_date").alias("token_symbol"),
        F.min_by("creation_date", "first_swap_date").alias("creation_date"),
        F.min("first_swap_date").alias("first_swap_date_")).withColumnRenamed("first_swap_date_", "first_swap_date")


def _refold_candles(p: DataFrame) -> DataFrame:
    return C.rollup_candles(p, "1 minute").drop("rise")


#: Partial aggregate of a batch and merge of partials, by roll-up.
ROLLUPS: dict[str, tuple[Callable[..., DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "candles_1m": (lambda s, q: C.candles(s, "1 minute", 1), _refold_candles),
    "token_swap_counts": (lambda s, q: C.token_swap_counts(s), _refold_swap_counts),
    "pool_stats_1h": (pool_stats_1h, _refold_stats),
    "last_prices": (last_prices, _refold_last),
    "daily_movers": (daily_movers, _refold_movers),
    "tokens_by_creation": (lambda s, q: tokens_by_creation(s), _refold_tokens),
}


def merge_batches(swaps: DataFrame, folder: str, checkpoint: str, names: list[str] | None = None,
                  quotes: list[str] | None = None) -> StreamingQuery:
    """Run the roll-ups over all available input; partials go to ``folder/<name>``."""
    names = names or list(ROLLUPS)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name in names:
            partial, _ = ROLLUPS[name]
            partial(batch, quotes).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        batch.unpersist()

    return swaps.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The merged roll-up."""
    return ROLLUPS[name][1](spark.read.parquet(f"{folder}/{name}").drop("batch"))


def compact(spark: SparkSession, folder: str, name: str, target: str) -> None:
    """Fold the partials written so far into one table."""
    read_rollup(spark, folder, name).write.mode("overwrite").parquet(target)


def on_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``fn(batch, batch_id)`` for each micro-batch, such as a changed-holders hook."""
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def after_restart(stream: DataFrame, last: tuple, order: tuple[str, ...] = OK.CHAIN_ORDER) -> DataFrame:
    """Rows after a known order key; the rest is the query checkpoint's work."""
    from tradeweft.operators.holders import after_checkpoint
    return after_checkpoint(stream, last, order)


def drop_repeats(stream: DataFrame, keys: list[str], ts: str = "timestamp", lateness: str = "10 minutes") -> DataFrame:
    """Duplicate guard: one row per key within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def pools_in_stream(logs: DataFrame, network: str, pools_path: str, swaps_path: str,
                    checkpoint: str) -> StreamingQuery:
    """Pools and swaps of a log stream: pools created in a batch are stored first, so that
    swaps of the same batch find them."""
    from tradeweft.operators.decode_evm import decode_pools, decode_swaps
    from tradeweft.operators.enrich import with_pool

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        decode_pools(batch, network).write.mode("overwrite").parquet(f"{pools_path}/batch={batch_id}")
        known = batch.sparkSession.read.parquet(pools_path).drop("batch")
        first = F.min_by(F.struct(*known.columns), F.struct("block_number", "transaction_index", "log_index"))
        known = known.groupBy("network", "pool").agg(first.alias("first")).select("first.*")
        with_pool(decode_swaps(batch), known).write.mode("overwrite").parquet(f"{swaps_path}/batch={batch_id}")
        batch.unpersist()

    return logs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
