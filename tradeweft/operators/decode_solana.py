"""Token program and metadata instructions to rows. ``data`` is hex without a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions import hexwords as H
from tradeweft.operators.dedup import dispatch

_BASE = ("block_number", "timestamp", "transaction_index", "instruction_address")
_TOKEN_PROGRAMS = [K.PROGRAM_TOKEN, K.PROGRAM_TOKEN_2022]


def _account(i: int):
    return F.get("accounts", F.lit(i))


def decode_spl_transfers(ins: DataFrame) -> DataFrame:
    """Transfers and checked transfers (which name the mint and the owner)."""
    d1 = H.discriminator(F.col("data"), 1)
    base = [F.col(c) for c in _BASE]
    amount = H.u64_le(F.col("data"), 1).alias("amount")
    rows = ins.filter(F.col("program_id").isin(_TOKEN_PROGRAMS)
                      & d1.isin(K.D1_TRANSFER, K.D1_TRANSFER_CHECKED))
    plain = [*base, _account(0).alias("source"), _account(1).alias("destination"),
             F.lit(None).cast("string").alias("mint"), _account(2).alias("owner"), amount]
    checked = [*base, _account(0).alias("source"), _account(2).alias("destination"),
               _account(1).alias("mint"), _account(3).alias("owner"), amount]
    return dispatch(rows, [(d1 == K.D1_TRANSFER, plain), (d1 == K.D1_TRANSFER_CHECKED, checked)])


def decode_mint_events(ins: DataFrame) -> DataFrame:
    """Mint initialisations (with decimals), mints and burns (with amount)."""
    d1 = H.discriminator(F.col("data"), 1)
    data = F.col("data")
    kind = F.when(d1.isin(K.D1_INITIALIZE_MINT), "init").when(d1.isin(K.D1_MINT), "mint").otherwise("burn")
    rows = ins.filter(F.col("program_id").isin(_TOKEN_PROGRAMS)
                      & d1.isin(K.D1_INITIALIZE_MINT + K.D1_MINT + K.D1_BURN))
    # A burn names the burned account first and the mint second.
    return rows.select(
        *_BASE, kind.alias("kind"), F.when(kind == "burn", _account(1)).otherwise(_account(0)).alias("mint"),
        F.when(kind == "init", H.u8(data, 1)).alias("decimals"),
        F.when(kind != "init", H.u64_le(data, 1)).alias("amount"))


def decode_metadata(events: DataFrame) -> DataFrame:
    """Created or updated token metadata from decoded metadata events (``args`` struct)."""
    return events.filter(F.col("program_id") == K.PROGRAM_METADATA).select(
        *_BASE, "kind", "metadata_acc", F.when(F.col("kind") == "create", F.col("mint")).alias("mint"),
        F.col("args.name").alias("name"), F.col("args.symbol").alias("symbol"),
        F.when(F.col("kind") == "create", F.col("args.is_mutable")).alias("mutable"))


def decode_upgrades(ins: DataFrame) -> DataFrame:
    """Program upgrades: the upgraded program is the second account."""
    return ins.filter((F.col("program_id") == K.PROGRAM_LOADER)
                      & (H.discriminator(F.col("data"), 4) == K.LOADER_UPGRADE_D4)).select(
        *_BASE, _account(1).alias("program_id"))
