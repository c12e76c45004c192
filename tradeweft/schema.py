"""Explicit schemas of the input and result tables (no inference)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<INT>": T.ArrayType(T.IntegerType()), "DECIMAL(38,0)": T.DecimalType(38, 0),
    "DECIMAL(38,18)": T.DecimalType(38, 18),
}


def _struct(columns: str) -> T.StructType:
    """``name TYPE, name TYPE``; needs no running session."""
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in pairs])


EVM_LOGS = _struct(
    "block_number BIGINT, timestamp TIMESTAMP, address STRING, topic0 STRING, topics ARRAY<STRING>, "
    "data STRING, transaction_hash STRING, transaction_index INT, log_index INT")
EVM_TRANSACTIONS = _struct("hash STRING, `from` STRING, `to` STRING, block_number BIGINT")
POOLS = _struct(
    "network STRING, dex_name STRING, protocol STRING, pool STRING, token_a STRING, token_b STRING, "
    "factory_address STRING, tick_spacing INT, fee INT, stable BOOLEAN, block_number BIGINT, "
    "transaction_index INT, log_index INT, transaction_hash STRING")
TOKENS_EVM = _struct("network STRING, address STRING, symbol STRING, decimals INT")
TOKENS_SOLANA = _struct(
    "mint STRING, decimals INT, issuance DECIMAL(38,18), issuance_tracked BOOLEAN, metadata_acc STRING, "
    "name STRING, symbol STRING, mutable BOOLEAN, created_at TIMESTAMP, created_at_block BIGINT, "
    "creation_tx STRING")
SOLANA_INSTRUCTIONS = _struct(
    "block_number BIGINT, timestamp TIMESTAMP, transaction_index INT, instruction_address ARRAY<INT>, "
    "program_id STRING, d1 STRING, d4 STRING, d8 STRING, accounts ARRAY<STRING>, data STRING, "
    "is_committed BOOLEAN")
TOKEN_BALANCES = _struct(
    "block_number BIGINT, transaction_index INT, account STRING, pre_mint STRING, post_mint STRING, "
    "pre_amount DECIMAL(38,0), post_amount DECIMAL(38,0), pre_decimals INT, post_decimals INT")
_TRADER = ", ".join(f"token_{s}_{c} DOUBLE" for s in "ab" for c in ("balance", "profit_usdc", "cost_usdc")) \
    + ", " + ", ".join(f"token_{s}_{c} BIGINT" for s in "ab" for c in ("wins", "loses"))
SWAPS_EVM = _struct(
    "timestamp TIMESTAMP, token_a STRING, token_a_symbol STRING, token_b STRING, token_b_symbol STRING, "
    "amount_a_raw STRING, amount_b_raw STRING, amount_a DOUBLE, amount_b DOUBLE, "
    "token_a_usdc_price DOUBLE, token_b_usdc_price DOUBLE, factory_address STRING, dex_name STRING, "
    "protocol STRING, pool_address STRING, pool_tick_spacing INT, pool_fee_creation BIGINT, "
    "pool_stable BOOLEAN, pool_liquidity STRING, pool_sqrt_price_x96 STRING, pool_tick INT, "
    "account STRING, sender STRING, recipient STRING, block_number BIGINT, transaction_index INT, "
    "log_index INT, transaction_hash STRING, token_a_decimals INT, token_b_decimals INT, "
    f"a_b_swapped BOOLEAN, {_TRADER}, sign INT")
SWAPS_SOLANA = _struct(
    "timestamp TIMESTAMP, dex STRING, token_a STRING, token_b STRING, amount_a DOUBLE, amount_b DOUBLE, "
    "token_a_symbol STRING, token_b_symbol STRING, token_a_decimals INT, token_b_decimals INT, "
    "token_a_creation_date TIMESTAMP, token_b_creation_date TIMESTAMP, token_a_usdc_price DOUBLE, "
    "token_b_usdc_price DOUBLE, token_a_pricing_pool STRING, token_b_pricing_pool STRING, "
    "token_a_best_pricing_pool_selected BOOLEAN, token_b_best_pricing_pool_selected BOOLEAN, "
    f"token_a_issuance DOUBLE, token_b_issuance DOUBLE, {_TRADER}, account STRING, block_number BIGINT, "
    "transaction_index INT, instruction_address ARRAY<INT>, transaction_hash STRING, slippage_pct DOUBLE, "
    "pool_address STRING, pool_token_a_reserve DOUBLE, pool_token_b_reserve DOUBLE, pool_tvl_usdc DOUBLE, "
    "sign INT")
TRANSFERS = _struct(
    "timestamp TIMESTAMP, token STRING, from_address STRING, to_address STRING, amount DECIMAL(38,0), "
    "block_number BIGINT, transaction_index INT, log_index INT, transaction_hash STRING, sign INT")
HOLDERS = _struct("timestamp TIMESTAMP, token STRING, holders BIGINT")
