"""Pairing of swap instructions with the token transfers inside their transaction.

All joins are on the transaction, which holds at most 64 instructions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TX = ["block_number", "transaction_index"]


def inner_transfers(ins: DataFrame, transfers: DataFrame, level: int | None = 1) -> DataFrame:
    """Transfers nested below each instruction, ``level`` steps deeper (None: any).

    ``ins``: block, transaction, instruction_address, ... ``transfers`` likewise with
    source, destination, owner, amount.
    """
    t = transfers.select(*TX, F.col("instruction_address").alias("transfer_address"),
                         "source", "destination", "owner", "amount")
    parent, child = F.col("instruction_address"), F.col("transfer_address")
    depth = F.size(child) - F.size(parent)
    deep = depth == level if level is not None else depth > 0
    under = F.slice(child, F.lit(1), F.size(parent)) == parent
    return ins.join(t, TX).filter(deep & under)


def pair_swap_legs(ins: DataFrame, transfers: DataFrame) -> DataFrame:
    """First inner transfer as the input leg, second as the output leg; instructions with
    fewer are dropped."""
    found = inner_transfers(ins, transfers, 1)
    by = [*TX, "instruction_address"]
    w = Window.partitionBy(*by).orderBy("transfer_address")
    ranked = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    rest = [c for c in ins.columns if c not in by]
    leg = F.struct("source", "destination", "owner", "amount")
    return ranked.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in rest],
        F.max(F.when(F.col("_n") == 1, leg)).alias("leg_in"),
        F.max(F.when(F.col("_n") == 2, leg)).alias("leg_out")).filter(F.col("leg_out").isNotNull())


def match_vault_legs(ins: DataFrame, transfers: DataFrame, exact_sum: bool,
                     level: int | None) -> tuple[DataFrame, DataFrame]:
    """Legs found by account: from the user's input account to one of the vaults, and from
    the other vault to the user's output account. Returns (good, bad).

    ``ins`` has user_in, user_out, vault_a, vault_b and amount_limit. With ``exact_sum`` the
    user's transfers add up to the limit and the largest one to a vault is the input leg;
    otherwise they stay within it and there is exactly one. The output leg is unique.
    """
    by = [*TX, "instruction_address"]
    found = inner_transfers(ins, transfers, level)
    amount = F.col("amount").cast("decimal(38,0)")
    from_user = F.col("source") == F.col("user_in")
    to_vault = from_user & (F.col("destination").isin(F.col("vault_a"), F.col("vault_b")))
    rest = [c for c in ins.columns if c not in by]
    rank = F.struct(amount.alias("a"), F.reverse("transfer_address").alias("b"))
    inputs = found.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in rest],
        F.coalesce(F.sum(F.when(from_user, amount)), F.lit(0)).alias("user_sum"),
        F.count_if(to_vault).alias("n_in"),
        F.max_by(F.struct("destination", "amount", "owner"), F.when(to_vault, rank)).alias("leg_in"),
        F.collect_list(F.struct("source", "destination", "amount")).alias("_all"))
    out_vault = F.when(F.col("leg_in.destination") == F.col("vault_a"), F.col("vault_b")) \
        .otherwise(F.col("vault_a"))
    outs = F.filter("_all", lambda t: (t["source"] == F.col("vault_out"))
                    & (t["destination"] == F.col("user_out")))
    rows = inputs.withColumn("vault_out", out_vault).withColumn("_outs", outs) \
        .withColumn("n_out", F.size("_outs")).withColumn("leg_out", F.get("_outs", F.lit(0))) \
        .drop("_all", "_outs")
    limit = F.col("amount_limit").cast("decimal(38,0)")
    sum_ok = (F.col("user_sum") == limit) if exact_sum else (F.col("user_sum") <= limit)
    one_in = (F.col("n_in") >= 1) if exact_sum else (F.col("n_in") == 1)
    reason = (F.when(~sum_ok, "input sum").when(~one_in, "input transfers")
              .when(F.col("n_out") > 1, "output transfers").when(F.col("n_out") == 0, "no output"))
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def validate_legs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split by the four source / destination equalities of a swap. Returns (good, bad)."""
    c = F.col
    ok = ((c("leg_in.source") == c("user_in")) & (c("leg_out.destination") == c("user_out"))
          & (c("leg_in.destination") == c("vault_in")) & (c("leg_out.source") == c("vault_out")))
    flagged = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("_ok").drop("_ok"), flagged.filter("not _ok").drop("_ok")


def token_of_transfer(transfers: DataFrame, balances: DataFrame) -> DataFrame:
    """Mint and decimals of each transfer from the balances of its two accounts.

    ``consistent`` is false where they disagree. A transfer without a balance row is lost.
    """
    by = [*TX, "transfer_address"]
    ends = transfers.select(*by, F.explode(F.array("source", "destination")).alias("account"))
    mint: Column = F.when(F.col("post_mint").isNotNull(), F.struct(
        F.col("post_mint").alias("mint"), F.col("post_decimals").alias("decimals"))).otherwise(F.struct(
            F.col("pre_mint").alias("mint"), F.col("pre_decimals").alias("decimals")))
    hits = ends.join(balances.select(*TX, "account", mint.alias("_t")), [*TX, "account"])
    return hits.groupBy(*by).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).select(
        *by, F.col("_lo.mint").alias("mint"), F.col("_lo.decimals").alias("decimals"),
        (F.col("_lo") == F.col("_hi")).alias("consistent"))
