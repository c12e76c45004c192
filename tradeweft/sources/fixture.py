"""Swap, transfer and log tables derived from generic order and event tables.

They give every operator an input that grows with the given tables: about one swap per
event and one transfer per order line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeweft.constants import ZERO_ADDRESS

SWAPS_SQL = """
WITH b AS (
  SELECT event_id, ts, user_id,
         event_id % 12 AS pool_no,
         CASE WHEN event_id % 12 = 0 THEN 5 ELSE (event_id % 12) % 5 END AS tok_no,
         1 + (event_id * 37) % 50 AS qty,
         100 + (event_id * 7919) % 41 AS px100,
         CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 1 ELSE -1 END AS side
  FROM {events})
SELECT CAST(ts AS TIMESTAMP) AS timestamp,
       CASE pool_no % 3 WHEN 0 THEN 'raydium' WHEN 1 THEN 'orca' ELSE 'uniswap_v3' END AS dex,
       concat('pool_', CAST(pool_no AS STRING)) AS pool_address,
       CASE WHEN tok_no = 5 THEN 'SOL' ELSE concat('T', CAST(tok_no AS STRING)) END AS token_a,
       CASE WHEN tok_no = 5 THEN 'USDC' WHEN pool_no % 4 = 1 THEN 'USDT'
            WHEN pool_no % 4 = 2 THEN 'SOL' WHEN pool_no % 4 = 3 THEN 'OTHER' ELSE 'USDC' END AS token_b,
       CAST(side * qty AS DOUBLE) AS amount_a,
       CAST(-side * qty * px100 AS DOUBLE) / CAST(100 AS DOUBLE) AS amount_b,
       CAST(px100 AS DOUBLE) / CAST(100 AS DOUBLE) AS token_a_usdc_price,
       CAST(1 AS DOUBLE) AS token_b_usdc_price,
       concat('acc_', CAST(user_id AS STRING)) AS account,
       CAST(event_id AS BIGINT) AS block_number,
       CAST(event_id % 200 AS INT) AS transaction_index,
       CAST(event_id % 7 AS INT) AS log_index,
       CAST(event_id % 23 AS DOUBLE) / CAST(2 AS DOUBLE) AS slippage_pct,
       CAST(10000 + event_id % 997 AS DOUBLE) AS pool_token_a_reserve,
       CAST(12000 + event_id % 991 AS DOUBLE) AS pool_token_b_reserve,
       1 AS sign
FROM b
"""

TRANSFERS_SQL = """
WITH m AS (
  SELECT l_orderkey, l_linenumber, min(l_shipdate) AS ts, min(l_suppkey) AS s,
         sum(CAST(l_quantity AS BIGINT)) AS q
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
SELECT CAST(m.ts AS TIMESTAMP) AS timestamp,
       concat('tok_', CAST(m.l_linenumber AS STRING)) AS token,
       concat('s_', CAST(m.s AS STRING)) AS from_address,
       concat('c_', CAST(o.o_custkey AS STRING)) AS to_address,
       CAST(m.q AS DECIMAL(38,0)) AS amount, m.l_orderkey AS transaction_index,
       CAST(m.l_linenumber AS INT) AS log_index, 1 AS sign
FROM m JOIN {orders} o ON o.o_orderkey = m.l_orderkey
UNION ALL
SELECT CAST('1990-01-01 00:00:00' AS TIMESTAMP),
       concat('tok_', CAST(l_linenumber AS STRING)), '""" + ZERO_ADDRESS + """',
       concat('s_', CAST(s AS STRING)), CAST(sum(q) + 1000 AS DECIMAL(38,0)), s,
       CAST(l_linenumber AS INT), 1
FROM m GROUP BY l_linenumber, s
"""

#: Quote tokens and stablecoins of the derived swaps, best first.
QUOTES = ["USDC", "USDT", "SOL"]
STABLES = ["USDC", "USDT"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def swaps(spark: SparkSession, folder: str) -> DataFrame:
    """Trader-view swaps (amount_a > 0 is a buy), already priced."""
    return spark.sql(SWAPS_SQL, events=table(spark, folder, "events"))


def swaps_evm(spark: SparkSession, folder: str) -> DataFrame:
    """The same swaps in the pool view (amount_a < 0 is a buy)."""
    df = swaps(spark, folder)
    return df.withColumns({"amount_a": -df.amount_a, "amount_b": -df.amount_b})


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TRANSFERS_SQL, lineitem=table(spark, folder, "lineitem"),
                     orders=table(spark, folder, "orders"))
