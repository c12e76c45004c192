"""Joins that turn decoded events into swaps.

Fact-to-fact joins shuffle on the transaction. Dimension joins carry no hint: Spark
broadcasts a dimension when its size is under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles, with AQE splitting hot pools or tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions.num import human_amount
from tradeweft.operators.ordered import asof_join


def with_tx(logs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Logs with the sender of their transaction; logs without one are dropped."""
    return logs.join(transactions.select(F.col("hash").alias("transaction_hash"),
                                         F.col("from").alias("account")), "transaction_hash")


def with_pool(swaps: DataFrame, pools: DataFrame, check_protocol: bool = True) -> DataFrame:
    """Swaps of known pools. The pool key is the event id where there is one, else the
    contract address; pool and swap must agree on the protocol family."""
    dim = pools.select(F.col("pool").alias("pool_address"), F.col("protocol").alias("_protocol"), "dex_name",
                       "token_a", "token_b", "factory_address", F.col("tick_spacing").alias("pool_tick_spacing"),
                       F.col("fee").alias("pool_fee_creation"), F.col("stable").alias("pool_stable"))
    keyed = swaps.withColumn("pool_address", F.coalesce("pool_id", "address"))
    out = keyed.join(dim, "pool_address")
    if check_protocol:
        # Two families share one swap event, so an event names all it can belong to.
        out = out.filter(F.array_contains("protocols", F.col("_protocol")))
    return out.withColumnRenamed("_protocol", "protocol")


def with_tokens(swaps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Decimals and symbol of both tokens, and human amounts."""
    for s in ("a", "b"):
        dim = tokens.select(F.col("address").alias(f"token_{s}"), F.col("decimals").alias(f"token_{s}_decimals"),
                            F.col("symbol").alias(f"token_{s}_symbol"))
        swaps = swaps.join(dim, f"token_{s}", "left").withColumns({
            f"token_{s}_symbol": F.coalesce(f"token_{s}_symbol", F.lit("")),
            f"amount_{s}": human_amount(F.col(f"amount_{s}_raw"), F.col(f"token_{s}_decimals"))})
    return swaps


def with_token_meta(swaps: DataFrame, tokens: DataFrame, issuances: DataFrame | None = None,
                    order: tuple[str, ...] = ("block_number", "transaction_index")) -> DataFrame:
    """Symbol and creation date of both tokens; issuance as of the swap when given
    (``issuances``: mint, the order columns, issuance)."""
    for s in ("a", "b"):
        dim = tokens.select(F.col("mint").alias(f"token_{s}"), F.col("symbol").alias(f"token_{s}_symbol"),
                            F.col("created_at").alias(f"token_{s}_creation_date"))
        swaps = swaps.join(dim, f"token_{s}", "left")
        if issuances is not None:
            right = issuances.select(F.col("mint").alias(f"token_{s}"), *order, "issuance")
            swaps = asof_join(swaps, right, on=list(order), by=[f"token_{s}"], values=["issuance"]) \
                .withColumnRenamed("issuance", f"token_{s}_issuance")
    return swaps


def with_curve(df: DataFrame, configs: DataFrame) -> DataFrame:
    """Curve type of the launch config; unknown configs use curve 0."""
    dim = configs.select(F.col("account").alias("global_config"), "curve_type")
    return df.join(dim, "global_config", "left").withColumn(
        "curve_type", F.coalesce("curve_type", F.lit(0)))


def with_reserves(swaps: DataFrame, balances: DataFrame) -> DataFrame:
    """Reserves of the two vaults before the transaction, from its balance rows."""
    tx = ["block_number", "transaction_index"]
    for side in ("in", "out"):
        right = balances.select(*tx, F.col("account").alias(f"vault_{side}"),
                                F.coalesce("pre_amount", F.lit(0)).alias(f"reserve_{side}"))
        swaps = swaps.join(right, [*tx, f"vault_{side}"])
    return swaps


def normalize_balances(balances: DataFrame) -> DataFrame:
    """Typed amounts and flags; mint and decimals after the transaction, else before."""
    return balances.select(
        "block_number", "transaction_index", "account", "pre_mint", "post_mint",
        F.col("pre_amount").cast("decimal(38,0)").alias("pre_amount"),
        F.col("post_amount").cast("decimal(38,0)").alias("post_amount"),
        F.col("pre_mint").isNotNull().alias("has_pre"), F.col("post_mint").isNotNull().alias("has_post"),
        F.coalesce("post_mint", "pre_mint").alias("mint"),
        F.coalesce("pre_decimals", "post_decimals").alias("decimals"))


def program_version(block: Column, tx: Column, versions: list[tuple[str, int, int]]) -> Column:
    """Name of the latest version that starts strictly before (block, transaction)."""
    expr: Column | None = None
    for name, from_block, from_tx in sorted(versions, key=lambda v: (v[1], v[2]), reverse=True):
        hit = (block > from_block) | ((block == from_block) & (tx > from_tx))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr


def upgrade_alerts(upgrades: DataFrame, versions: DataFrame) -> DataFrame:
    """Upgrades of tracked programs at an unknown (block, transaction).

    ``versions``: program_id, block_number, transaction_index of known upgrades; programs
    without one have a row with NULL position.
    """
    tracked = versions.select(F.col("program_id")).distinct()
    known = versions.filter(F.col("block_number").isNotNull())
    return upgrades.join(tracked, "program_id", "left_semi").join(
        known, ["program_id", "block_number", "transaction_index"], "left_anti")
