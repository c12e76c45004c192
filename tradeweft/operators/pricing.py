"""USD prices of swaps without a sequential loop.

Prices depend on earlier prices only through reference tokens, and those form a short
chain (stablecoin -> native token -> the rest). So prices are computed level by level:
updates of a level, then an as-of join to the swaps quoted in it. The as-of join is safe
for the hot native token (see :mod:`tradeweft.operators.ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions.keys import CHAIN_ORDER
from tradeweft.functions.num import pair_price
from tradeweft.functions.time import prev_hour
from tradeweft.operators.filters import orient_pair_evm, priceable_evm
from tradeweft.operators.ordered import CHUNK, asof_join, chunk, last_n, with_history
from tradeweft.operators.pools import pool_stats_1h, rolling_best_pool
from tradeweft.session import written_table


def ref_price_median(updates: DataFrame, n: int = 10, by: Sequence[str] = ("token",),
                     order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """Median of the last ``n`` prices after each update; NULL until ``n`` were seen."""
    ch = with_history(chunk(updates, by, order), n - 1)
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(-(n - 1), 0)
    prices = F.array_sort(F.collect_list("price").over(w))
    lo, hi = (n - 1) // 2, n // 2
    out = ch.df.withColumn("_s", prices).filter(~F.col("_halo"))
    median = (F.get("_s", F.lit(lo)) + F.get("_s", F.lit(hi))) / 2
    return out.select(*by, *order, "price",
                      F.when(F.size("_s") == n, median).alias("ref_price"))


def price_evm(swaps: DataFrame, refs: list[tuple[str, str]], usdc: str, n: int = 10,
              order: Sequence[str] = CHAIN_ORDER, history: DataFrame | None = None) -> DataFrame:
    """Oriented swaps with ``token_{a,b}_usdc_price`` (0 where there is no price).

    B is priced by the median of the last ``n`` prices of its own reference pool, before
    this swap; A by the ratio. ``refs`` lists (token, reference pool), most fundamental
    first; ``history`` holds earlier updates (token, price, order columns) to start from.
    """
    tokens = [t for t, _ in refs]
    # Every level reads them, and orientation is a large expression: worked out once.
    base = written_table(orient_pair_evm(swaps, tokens), "oriented")
    fit = base.filter(priceable_evm(usdc, tokens))
    ratio = F.abs(F.col("amount_b")) / F.abs(F.col("amount_a"))
    own_pool = F.lit(False)
    for token, pool in refs:
        own_pool = own_pool | ((F.col("token_a") == token) & (F.col("pool_address") == pool))
    # Only swaps of the reference pools; every level reads them, so they are written once.
    moves = written_table(fit.filter(own_pool).select("token_a", "token_b", *order, ratio.alias("_ratio")), "moves")
    # Which reference token is quoted in which: a pool has one pair of tokens, so the pairs are
    # bounded by the reference pools (twice, where a pool's sides are switched).
    pairs = [(r.token_a, r.token_b) for r in moves.select("token_a", "token_b").distinct().collect()]
    medians = _no_medians(moves, order)
    if history is not None:
        old = history.select("token", *order, "price")
    ready, todo = {usdc}, [p for p in pairs]
    while True:
        level = [p for p in todo if p[1] in ready]
        if not level:
            break
        todo = [p for p in todo if p not in level]
        names = sorted({a for a, _ in level})
        rows = moves.filter(F.col("token_a").isin(names))
        priced = _with_quote(rows, medians, usdc, order).select(
            F.col("token_a").alias("token"), *order, (F.col("_ratio") * F.col("_pb")).alias("price")) \
            .filter(F.col("price").isNotNull())
        if history is not None:
            priced = priced.unionByName(old.filter(F.col("token").isin(names)))
        found = written_table(ref_price_median(priced, n, ["token"], order).drop("price"), "medians")
        medians = medians.unionByName(found)
        # A token is ready once all its pairs are priced.
        ready |= {a for a, _ in level if all(p[0] != a for p in todo)}
    if history is not None:
        rest = [t for t in tokens if t not in ready]
        seeded = ref_price_median(old.filter(F.col("token").isin(rest)), n, ["token"], order).drop("price")
        medians = medians.unionByName(seeded)
    priced = _with_quote(fit.withColumn("_ratio", ratio), medians, usdc, order) \
        .withColumns({"token_b_usdc_price": F.coalesce("_pb", F.lit(0.0)),
                      "token_a_usdc_price": F.coalesce(F.col("_ratio") * F.col("_pb"), F.lit(0.0))}) \
        .drop("_pb", "_ratio")
    rest = base.filter(~F.coalesce(priceable_evm(usdc, tokens), F.lit(False))) \
        .withColumns({"token_b_usdc_price": F.lit(0.0), "token_a_usdc_price": F.lit(0.0)})
    return priced.unionByName(rest.select(*priced.columns))


def reference_history(priced: DataFrame, refs: list[tuple[str, str]], n: int = 10, order: Sequence[str] = CHAIN_ORDER,
                      history: DataFrame | None = None) -> DataFrame:
    """What a later run of :func:`price_evm` has to know of this one: the last ``n`` prices of each reference
    token in its own pool (token, price, order columns). At most ``n`` rows per reference token.

    ``priced`` is the result of the run, ``history`` what that run itself started from.
    """
    own = F.lit(False)
    for token, pool in refs:
        own = own | ((F.col("token_a") == token) & (F.col("pool_address") == pool))
    moved = priced.filter(own & (F.col("token_a_usdc_price") > 0)).select(
        F.col("token_a").alias("token"), *order, F.col("token_a_usdc_price").alias("price"))
    if history is not None:
        moved = moved.unionByName(history.select(*moved.columns))
    return last_n(moved, ["token"], order, n)


def _no_medians(moves: DataFrame, order: Sequence[str]) -> DataFrame:
    return moves.filter("false").select(F.col("token_a").alias("token"), *order,
                                        F.lit(0.0).alias("ref_price"))


def _with_quote(rows: DataFrame, medians: DataFrame, usdc: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``_pb``: 1 for the stablecoin, else the latest median before the row."""
    stable = rows.filter(F.col("token_b") == usdc).withColumn("_pb", F.lit(1.0))
    other = asof_join(rows.filter(F.col("token_b") != usdc),
                      medians.withColumnRenamed("token", "token_b"), on=list(order),
                      by=["token_b"], values=["ref_price"]).withColumnRenamed("ref_price", "_pb")
    return stable.unionByName(other)


def price_quote(swaps: DataFrame, quotes: list[str] | None = None, stables: list[str] | None = None,
                order: Sequence[str] = CHAIN_ORDER, days: int = 14) -> DataFrame:
    """Oriented swaps (B is the better quote) with prices and pricing pools; see :func:`price_quote_from`."""
    return price_quote_from(swaps, None, quotes, stables, order, days)[0]


def price_quote_from(swaps: DataFrame, opening: dict[str, DataFrame] | None, quotes: list[str] | None = None,
                     stables: list[str] | None = None, order: Sequence[str] = CHAIN_ORDER,
                     days: int = 14) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Prices from an earlier state on, and the state after these swaps.

    The state has the last stored price of each token (``prices``: token, order columns, price, pool,
    is_best) and the hourly volumes of pools in the last ``days`` (``stats``), which choose best pools.
    Runs have to follow each other in order and in time; a cut may fall anywhere between two hours.

    Stablecoins are 1. A token against a priced quote is priced by the ratio. Its stored
    price moves with swaps of its best pool of the previous hour (14-day volume), or of any
    quote pool while it has none; other swaps take the stored price. Stored prices follow
    the best pool of each hour; when that changes, the first trade in the new pool is when
    the price moves over.
    """
    quotes, stables = list(quotes or K.QUOTE_TOKENS), list(stables or K.USD_STABLECOINS)
    natives = [q for q in quotes if q not in stables]
    ratio = pair_price(F.col("amount_a"), F.col("amount_b"))
    live = (F.col("amount_a") != 0) & (F.col("amount_b") != 0)
    b_stable, b_native = F.col("token_b").isin(stables), F.col("token_b").isin(natives)

    seen: list[DataFrame] = []

    def updates(rows: DataFrame, level: Column) -> DataFrame:
        """Stored price of A after each swap that may set it, with the last ones from before."""
        stats = pool_stats_1h(rows.withColumns({"sign": F.lit(1), "dex": F.lit("")}), quotes)
        if opening is not None:
            stats = stats.unionByName(opening["stats"].withColumnRenamed("token", "token_a").filter(level).select(*stats.columns))
        seen.append(stats)
        want = rows.select("token_a", prev_hour(F.col("timestamp")).alias("hour_ts"))
        best = rolling_best_pool(stats, days, want).select("token_a", F.col("hour_ts").alias("_hour"), "best_pool")
        tagged = rows.withColumn("_hour", prev_hour(F.col("timestamp"))).join(best, ["token_a", "_hour"], "left")
        mine = F.col("best_pool").isNull() | (F.col("best_pool") == F.col("pool_address"))
        moved = tagged.filter(live & ~F.col("token_a").isin(stables) & mine
                             & F.col("token_a_usdc_price").isNotNull()).select(
            F.col("token_a").alias("token"), *order, F.col("token_a_usdc_price").alias("price"),
            F.col("pool_address").alias("pool"), F.col("best_pool").isNotNull().alias("is_best"))
        if opening is not None:
            old = opening["prices"].withColumnRenamed("token", "token_a").filter(level).withColumnRenamed("token_a", "token")
            moved = moved.unionByName(old.select(*moved.columns))
        return written_table(moved, "updates")

    by_stable = swaps.filter(b_stable).withColumns(
        {"token_b_usdc_price": F.lit(1.0), "_b_pool": F.lit("[NONE]"), "_b_best": F.lit(True),
         "token_a_usdc_price": F.when(live, ratio)})
    # Level 1: native quote tokens against stablecoins.
    is_native = F.col("token_a").isin(natives)
    native = updates(by_stable.filter(is_native), is_native)
    stored = asof_join(swaps.filter(b_native), native.withColumnRenamed("token", "token_b"),
                       on=list(order), by=["token_b"], values=["price", "pool", "is_best"]) \
        .withColumnsRenamed({"price": "token_b_usdc_price", "pool": "_b_pool", "is_best": "_b_best"})
    by_native = stored.withColumn("token_a_usdc_price", F.when(live, ratio * F.col("token_b_usdc_price")))
    quoted = by_stable.unionByName(by_native)
    # Level 2: everything against a quote token.
    moves = native.unionByName(updates(quoted.filter(~is_native), ~is_native))
    # Level 3: swaps without a usable quote take stored prices of both tokens.
    done = quoted.filter(F.col("token_a_usdc_price").isNotNull()) \
        .withColumns({"_a_pool": F.lit(None).cast("string"), "_a_best": F.lit(None).cast("boolean")})
    left = quoted.filter(F.col("token_a_usdc_price").isNull()).drop("token_a_usdc_price")
    other = swaps.filter(~b_stable & ~b_native)
    vals = {"price": "price_usdc", "pool": "pool", "is_best": "best"}
    other = asof_join(other, moves.withColumnRenamed("token", "token_b"), on=list(order), by=["token_b"],
                      values=list(vals)).withColumnsRenamed(
        {"price": "token_b_usdc_price", "pool": "_b_pool", "is_best": "_b_best"})
    rest = other.unionByName(left)
    a_stable = F.col("token_a").isin(stables)
    rest = asof_join(rest, moves.withColumnRenamed("token", "token_a"), on=list(order), by=["token_a"],
                     values=list(vals)).withColumnsRenamed(
        {"price": "token_a_usdc_price", "pool": "_a_pool", "is_best": "_a_best"})
    rest = rest.withColumns({
        "token_a_usdc_price": F.when(a_stable, 1.0).otherwise(F.col("token_a_usdc_price")),
        "_a_pool": F.when(a_stable, "[NONE]").otherwise(F.col("_a_pool")),
        "_a_best": F.when(a_stable, True).otherwise(F.col("_a_best"))})
    out = done.unionByName(rest)
    fixed = {}
    for s in ("a", "b"):
        fixed[f"token_{s}_usdc_price"] = F.coalesce(f"token_{s}_usdc_price", F.lit(0.0))
        fixed[f"token_{s}_pricing_pool"] = F.coalesce(f"_{s}_pool", F.lit(""))
        fixed[f"token_{s}_best_pricing_pool_selected"] = F.coalesce(f"_{s}_best", F.lit(False))
    rest = [c for c in moves.columns if c != "token"]
    prices = moves.groupBy("token").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_p")).select("token", "_p.*")
    keys = [c for c in seen[0].columns if c != "volume_1h_usdc"]
    stats = seen[0].unionByName(seen[1]).groupBy(*keys).agg(F.sum("volume_1h_usdc").alias("volume_1h_usdc"))
    newest = stats.agg(F.max("hour_ts").alias("_to"))
    stats = stats.join(F.broadcast(newest), F.col("hour_ts") >= F.col("_to") - F.expr(f"INTERVAL {int(days)} DAY")).drop("_to")
    return out.withColumns(fixed).drop("_a_pool", "_a_best", "_b_pool", "_b_best"), {"prices": prices, "stats": stats}


def latest_before(df: DataFrame, ts, by: Sequence[str], values: Sequence[str],
                  order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """Latest row not after ``ts`` per key."""
    return df.filter(F.col("timestamp") <= F.lit(ts).cast("timestamp")).groupBy(*by).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*by, "_v.*")

