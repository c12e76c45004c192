"""Scans. Filters are plain predicates on flat columns, so they reach the Parquet reader;
only the named columns are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft import schema as S
from tradeweft.operators.filters import block_range


def _load(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_logs(spark: SparkSession, path: str, topics: Sequence[str], addresses: Sequence[str] | None = None,
              blocks: tuple[int, int] | None = None) -> DataFrame:
    """Event logs by topic and, optionally, contract and block range."""
    return select_logs(_load(spark, path, S.EVM_LOGS), topics, addresses, blocks)


def select_logs(logs: DataFrame, topics: Sequence[str], addresses: Sequence[str] | None = None,
                blocks: tuple[int, int] | None = None) -> DataFrame:
    out = logs.filter(F.col("topic0").isin(list(topics)))
    if addresses:
        out = out.filter(F.col("address").isin([a.lower() for a in addresses]))
    return block_range(out, *blocks) if blocks else out


def read_transfer_logs(spark: SparkSession, path: str, contracts: Sequence[str] | None = None) -> DataFrame:
    return read_logs(spark, path, [K.TOPIC_TRANSFER], contracts)


def select_instructions(ins: DataFrame, types: Sequence[str] | None = None, only_meta: bool = False) -> DataFrame:
    """Committed instructions of the tracked programs: token, metadata and upgrade ones,
    and the swaps of the chosen market maker types unless ``only_meta``."""
    types = list(types or K.SWAP_D8)
    p, d1, d4, d8 = (F.col(c) for c in ("program_id", "d1", "d4", "d8"))
    token = p.isin(K.PROGRAM_TOKEN, K.PROGRAM_TOKEN_2022) & d1.isin(K.D1_INITIALIZE_MINT + K.D1_MINT + K.D1_BURN)
    wanted = token | ((p == K.PROGRAM_METADATA) & d1.isin(K.D1_CREATE_METADATA + K.D1_UPDATE_METADATA)) \
        | ((p == K.PROGRAM_LOADER) & (d4 == K.LOADER_UPGRADE_D4))
    if "raydium_launchlab" in types:
        wanted = wanted | ((p == K.PROGRAM_AMM["raydium_launchlab"]) & (d8 == K.LAUNCHLAB_CREATE_CONFIG_D8))
    if not only_meta:
        for t in types:
            wanted = wanted | ((p == K.PROGRAM_AMM[t]) & d8.isin(K.SWAP_D8[t]))
    return ins.filter(F.col("is_committed") & wanted)


def read_instructions(spark: SparkSession, path: str, types: Sequence[str] | None = None,
                      only_meta: bool = False, blocks: tuple[int, int] | None = None) -> DataFrame:
    out = select_instructions(_load(spark, path, S.SOLANA_INSTRUCTIONS), types, only_meta)
    return block_range(out, *blocks) if blocks else out


def select_holder_balances(balances: DataFrame, ins: DataFrame) -> DataFrame:
    """Token balances of transactions that change holders: mint, transfer, burn or init."""
    d1s = K.D1_INITIALIZE_MINT + K.D1_MINT + K.D1_BURN + [K.D1_TRANSFER, K.D1_TRANSFER_CHECKED]
    both = F.col("d1").isin(d1s)
    newer = (F.col("program_id") == K.PROGRAM_TOKEN_2022) & F.col("d1").isin(K.D1_TRANSFER_FEE, K.D1_TRANSFER_HOOK)
    hits = ins.filter(F.col("is_committed") & F.col("program_id").isin(K.PROGRAM_TOKEN, K.PROGRAM_TOKEN_2022)
                      & (both | newer))
    return balances.join(hits.select("block_number", "transaction_index"),
                         ["block_number", "transaction_index"], "left_semi")


def read_token_balances(spark: SparkSession, balances_path: str, instructions_path: str) -> DataFrame:
    return select_holder_balances(_load(spark, balances_path, S.TOKEN_BALANCES),
                                  _load(spark, instructions_path, S.SOLANA_INSTRUCTIONS))


def read_csv_series(spark: SparkSession, path: str, schema: str, ts: str = "timestamp",
                    required: Sequence[str] | None = None) -> DataFrame:
    """A CSV time series in time order without incomplete rows."""
    rows = spark.read.csv(path, schema=schema, header=True)
    return rows.dropna(subset=list(required or rows.columns)).orderBy(ts)
