"""Pool volumes, best pools and last prices of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.functions import keys as OK
from tradeweft.functions.market import is_quote, usd_volume
from tradeweft.functions.time import bucket

_PAIR = ("token_a", "token_b", "dex", "pool_address")


def pool_stats_1h(swaps: DataFrame, quotes: list[str] | None = None) -> DataFrame:
    """Hourly volume of pools that trade against a quote token."""
    return swaps.filter(is_quote(F.col("token_b"), quotes)).groupBy(
        bucket(F.col("timestamp"), "1 hour").alias("hour_ts"), *_PAIR
    ).agg(F.sum(usd_volume() * F.col("sign")).alias("volume_1h_usdc"))


def best_quote_pools(stats: DataFrame, lo, hi) -> DataFrame:
    """Pool with the highest volume per token in ``[lo, hi]``; ties go to the first pool."""
    total = stats.filter(F.col("hour_ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp"))) \
        .groupBy(*_PAIR).agg(F.sum("volume_1h_usdc").alias("total_volume_usdc"))
    best = F.min_by(F.struct("token_b", "dex", "pool_address"),
                    F.struct(-F.col("total_volume_usdc"), F.col("pool_address"),
                             F.col("token_b"), F.col("dex"))).alias("_best")
    return total.groupBy("token_a").agg(best, F.max("total_volume_usdc").alias("total_volume_usdc")) \
        .select("token_a", "_best.*", "total_volume_usdc")


def rolling_best_pool(stats: DataFrame, days: int = 14, hours: DataFrame | None = None) -> DataFrame:
    """Best pool per token and hour, by volume of the ``days`` up to that hour (inclusive).

    Evaluated at ``hours`` (token_a, hour_ts), by default the hours in which the token traded. The volume
    of a pool changes when an hour enters or leaves its window; between two changes it stands, and the
    interval is cut into aligned runs of 1, 2, 4, ... hours. The best pool of each run is one aggregate,
    and an hour asks the runs that hold it. A pool-hour gives two changes and a few runs, whatever the
    length of the window, and no pair of pools meets. Volumes are summed as decimals, so that what leaves
    is what has entered.
    """
    span = 24 * days + 1
    levels = range(span.bit_length() + 1)
    hour = F.expr("unix_seconds(hour_ts) DIV 3600")
    hourly = stats.groupBy("token_a", "pool_address", hour.alias("_h")).agg(F.sum("volume_1h_usdc").cast("decimal(38,12)").alias("_v"))
    moves = F.array(F.struct(F.col("_h"), F.col("_v"), F.lit(1).alias("_n")), F.struct((F.col("_h") + span).alias("_h"), (-F.col("_v")).alias("_v"), F.lit(-1).alias("_n")))
    steps = hourly.select("token_a", "pool_address", F.explode(moves).alias("_m")).groupBy("token_a", "pool_address", F.col("_m._h").alias("_h")).agg(
        F.sum("_m._v").alias("_v"), F.sum("_m._n").alias("_n"))
    own = Window.partitionBy("token_a", "pool_address").orderBy("_h")  # at most two rows for an hour of the clock
    level = steps.select("token_a", "pool_address", "_h", F.lead("_h").over(own).alias("_to"), F.sum("_v").over(own).cast("decimal(38,12)").alias("_v"),
                         F.sum("_n").over(own).alias("_n")).filter(F.col("_n") > 0)
    runs = []
    for k in levels:
        lo, hi = F.shiftright(F.col("_h") + (2 ** k - 1), k), F.shiftright("_to", k)
        for odd, block in ((lo, lo), (hi, hi - 1)):
            runs.append(F.when((lo < hi) & (odd % 2 == 1), F.struct(F.lit(k).alias("k"), block.alias("b"))))
    best = level.select("token_a", "pool_address", "_v", F.explode(F.array_compact(F.array(*runs))).alias("_r")).groupBy(
        "token_a", F.col("_r.k").alias("_k"), F.col("_r.b").alias("_b")).agg(F.min(F.struct((-F.col("_v")).alias("v"), F.col("pool_address").alias("p"))).alias("_best"))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(hour, k).alias("b")) for k in levels])
    wanted = (stats if hours is None else hours).select("token_a", "hour_ts").distinct().select(
        "token_a", "hour_ts", F.explode(asked).alias("_r")).select("token_a", "hour_ts", F.col("_r.k").alias("_k"), F.col("_r.b").alias("_b"))
    return wanted.join(best, ["token_a", "_k", "_b"]).groupBy("token_a", "hour_ts").agg(F.min("_best").alias("_best")).select(
        "token_a", "hour_ts", F.col("_best.p").alias("best_pool"), (-F.col("_best.v")).cast("double").alias("volume_usdc"))


def last_prices(swaps: DataFrame, quotes: list[str] | None = None,
                order: Column | None = None) -> DataFrame:
    """Last price per (token, quote, pool), with its order key."""
    key = OK.schema_order_key(swaps) if order is None else order
    rows = swaps.filter((F.col("token_a_usdc_price") > 0) & (F.col("sign") > 0)
                        & is_quote(F.col("token_b"), quotes)) \
        .select("token_a", "token_b", "pool_address", "timestamp",
                F.col("token_a_usdc_price").alias("_p"), key.alias("_key"))
    return rows.groupBy("token_a", "token_b", "pool_address").agg(
        F.max("timestamp").alias("swap_timestamp"), F.max("_key").alias("order_key"),
        F.max_by("_p", "_key").alias("price_usdc"))


def last_best_prices(last: DataFrame, best: DataFrame) -> DataFrame:
    """Last price of each token in its best pool, or in the pool it traded in last.

    ``last`` is :func:`last_prices`, ``best`` :func:`best_quote_pools`. Both hold one row per
    pool or token, so the joins are on small tables; Spark picks broadcast by size.
    """
    last_pool = last.groupBy("token_a").agg(F.max_by("pool_address", "order_key").alias("last_pool"))
    rows = last.join(best.select("token_a", F.col("pool_address").alias("best_pool_address")),
                     "token_a", "left").join(last_pool, "token_a", "left")
    rows = rows.filter(F.when(F.col("best_pool_address").isNotNull(),
                              F.col("pool_address") == F.col("best_pool_address"))
                       .otherwise(F.col("pool_address") == F.col("last_pool")))
    return rows.groupBy(F.col("token_a").alias("token"), "pool_address", "best_pool_address").agg(
        F.max_by("price_usdc", "order_key").alias("price_usdc"))


def last_best_prices_legacy(swaps: DataFrame, best: DataFrame, quotes: list[str] | None = None,
                            order: Column | None = None) -> DataFrame:
    """The older form straight from the swaps: one row per token."""
    key = OK.schema_order_key(swaps) if order is None else order
    # The CASE reads only pool, quote and best pool: aggregate per pool before the join.
    pools = swaps.filter((F.col("token_a_usdc_price") > 0) & (F.col("sign") > 0)).select(
        "token_a", "token_b", "pool_address", F.col("token_a_usdc_price").alias("_p"), key.alias("_key")
    ).groupBy("token_a", "token_b", "pool_address").agg(
        F.max("_key").alias("_key"), F.max_by("_p", "_key").alias("_p"))
    rows = pools.join(best.select("token_a", F.col("pool_address").alias("best_pool_address")),
                      "token_a", "left")
    rows = rows.filter(F.when(F.col("best_pool_address").isNotNull(),
                              F.col("pool_address") == F.col("best_pool_address"))
                       .otherwise(is_quote(F.col("token_b"), quotes)))
    return rows.groupBy(F.col("token_a").alias("token")).agg(
        F.max_by("pool_address", "_key").alias("pool_address"),
        F.max_by("best_pool_address", "_key").alias("best_pool_address"),
        F.max_by("_p", "_key").alias("price_usdc"))
