"""Fact table sinks and layouts.

A fact table is written by month and, inside a month, clustered by its access path: time,
pool, account or token. Clustering is a range partition on (month, key, order), so a hot
pool is spread over several files instead of filling one task, and the row-group
statistics of each file cover a narrow key range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft import schema as S
from tradeweft.functions.keys import CHAIN_ORDER
from tradeweft.functions.market import is_quote, pool_tvl
from tradeweft.functions.num import decimal_string
from tradeweft.functions.time import yyyymm

#: Clustering keys by layout.
LAYOUTS = {"time": (), "pool": ("pool_address",), "account": ("account",), "token": ("token",)}
#: Columns that get a bloom filter, for lookups that do not follow the clustering.
BLOOM = ("account", "pool_address")

_EPOCH = "1970-01-01 00:00:00"


def clustered_copy(df: DataFrame, layout: str, order: Sequence[str] = CHAIN_ORDER,
                   partitions: int | None = None) -> DataFrame:
    """Rows arranged for a layout, with their ``yyyymm`` partition column."""
    keys = LAYOUTS[layout]
    out = df.withColumn("yyyymm", yyyymm(F.col("timestamp")))
    cols = ["yyyymm", *keys, *order]
    n = [partitions] if partitions else []
    return out.repartitionByRange(*n, *cols).sortWithinPartitions(*cols)


def write_table(df: DataFrame, path: str, layout: str = "time", order: Sequence[str] = CHAIN_ORDER,
                mode: str = "append") -> None:
    writer = clustered_copy(df, layout, order).write.mode(mode).partitionBy("yyyymm")
    for c in BLOOM:
        if c in df.columns and c not in LAYOUTS[layout]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def _conform(df: DataFrame, schema) -> DataFrame:
    """Columns of the schema in its order; missing ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema])


def swaps_evm_rows(df: DataFrame) -> DataFrame:
    """Decoded, priced swaps as rows of the EVM fact table."""
    out = df
    for s in ("a", "b"):
        if f"amount_{s}_text" in df.columns:
            out = out.withColumn(f"amount_{s}_raw", F.col(f"amount_{s}_text"))
    return _conform(out.withColumn("sign", F.lit(1)), S.SWAPS_EVM)


def swaps_solana_rows(df: DataFrame) -> DataFrame:
    """Priced swaps as rows of the Solana fact table, with its defaults."""
    fill = {"token_a_symbol": "[unknown]", "token_b_symbol": "[unknown]",
            "token_a_pricing_pool": "", "token_b_pricing_pool": "",
            **{f"token_{s}_{c}": 0.0 for s in "ab" for c in
               ("usdc_price", "issuance", "balance", "profit_usdc", "cost_usdc")},
            **{f"token_{s}_{c}": 0 for s in "ab" for c in ("wins", "loses")}}
    out = _conform(df.withColumn("sign", F.lit(1)), S.SWAPS_SOLANA)
    out = out.withColumns({c: F.coalesce(F.when(F.col(c) == "", None).otherwise(F.col(c)) if isinstance(v, str)
                                         else F.col(c), F.lit(v)) for c, v in fill.items()})
    epoch = F.lit(_EPOCH).cast("timestamp")
    return out.withColumns({
        "token_a_creation_date": F.coalesce("token_a_creation_date", epoch),
        "token_b_creation_date": F.coalesce("token_b_creation_date", epoch),
        "pool_tvl_usdc": pool_tvl()})


def raw_to_decimal(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Raw integer columns as decimal strings; ``columns``: amount column -> decimals column."""
    return df.withColumns({c: decimal_string(F.col(c), F.col(d)) for c, d in columns.items()})


def write_swaps_evm(df: DataFrame, path: str, layout: str = "time") -> None:
    write_table(swaps_evm_rows(df), path, layout)


def write_swaps_solana(df: DataFrame, path: str, layout: str = "time",
                       order: Sequence[str] = ("block_number", "transaction_index", "instruction_address")) -> None:
    write_table(swaps_solana_rows(df), path, layout, order)


def write_transfers(df: DataFrame, path: str, layout: str = "time") -> None:
    write_table(_conform(df.withColumn("sign", F.lit(1)), S.TRANSFERS), path, layout)


def holders_rows(snapshots: DataFrame, ts: str = "bucket_ts") -> DataFrame:
    return snapshots.select(F.col(ts).alias("timestamp"), "token", F.col("holders").cast("long").alias("holders"))


def write_holders(snapshots: DataFrame, path: str, ts: str = "bucket_ts") -> None:
    write_table(holders_rows(snapshots, ts), path, "token", ("timestamp",))


def write_first_transfers(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def account_copy(swaps: DataFrame) -> DataFrame:
    """The narrow copy for position lookups: priced rows only."""
    return swaps.filter((F.col("token_a_usdc_price") > 0) & (F.col("token_b_usdc_price") > 0)).select(
        "timestamp", "account", "token_a", "token_b", "amount_a", "amount_b", "token_a_usdc_price",
        "token_b_usdc_price", "transaction_index", "log_index", "sign")


def account_positions_source(swaps: DataFrame, quotes: list[str] | None = None,
                             order: Sequence[str] = ("block_number", "transaction_index", "instruction_address")
                             ) -> DataFrame:
    """Rows that move positions against a quote token."""
    return swaps.filter(((F.col("amount_a") > 0) | (F.col("amount_b") > 0))
                        & is_quote(F.col("token_b"), quotes)).select(
        "sign", "timestamp", "account", "token_a", "token_b", "amount_a", "amount_b",
        "token_a_usdc_price", "token_b_usdc_price", *order)
