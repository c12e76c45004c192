"""Registry of checks: a Spark query over the given tables and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeweft.sources import fixture as X

#: Fixed point of time inside the event tables, in place of "now".
NOW = "2024-01-28 10:30:00"
START, END = "2024-01-03 00:00:00", "2024-01-25 12:00:00"
QUOTES = X.QUOTES
Q_SQL = "('USDC','USDT','SOL')"

#: Trader statistics as plain projections, for queries that only aggregate them.
STATS_SQL = """
  CAST(block_number % 7 AS BIGINT) AS token_a_wins, CAST(block_number % 5 AS BIGINT) AS token_a_loses,
  CAST(block_number % 13 - 6 AS DOUBLE) / CAST(4 AS DOUBLE) AS token_a_profit_usdc,
  CAST(block_number % 11 AS DOUBLE) AS token_a_cost_usdc,
  concat('SYM_', token_a) AS token_a_symbol,
  CASE WHEN token_a IN ('T1', 'T2') THEN CAST('2023-11-01 06:00:00' AS TIMESTAMP)
       ELSE CAST('2023-12-29 00:00:00' AS TIMESTAMP) END AS token_a_creation_date"""

SIGNALS_SQL = """
SELECT block_number AS signal_id, token_a AS token, pool_address AS pool, dex, timestamp,
       token_a_usdc_price AS entry_price, abs(amount_b * token_b_usdc_price) AS size_usdc
FROM {swaps} WHERE amount_a > 0 AND abs(amount_b * token_b_usdc_price) > 60"""

CTE = f"""WITH swaps AS ({X.SWAPS_SQL.format(events='events')}),
evm AS (SELECT * REPLACE (-amount_a AS amount_a, -amount_b AS amount_b) FROM swaps),
xs AS (SELECT *, {STATS_SQL} FROM swaps),
xe AS (SELECT *, {STATS_SQL} FROM evm),
transfers AS ({X.TRANSFERS_SQL.format(lineitem='lineitem', orders='orders')}),
signals AS ({SIGNALS_SQL.format(swaps='swaps')}),
tvl AS (SELECT *, abs(pool_token_a_reserve * token_a_usdc_price)
          + abs(pool_token_b_reserve * token_b_usdc_price) AS pool_tvl FROM swaps)
"""


class Tables:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return X.table(self.spark, self.folder, name)

    @cached_property
    def swaps(self) -> DataFrame:
        return X.swaps(self.spark, self.folder)

    @cached_property
    def evm(self) -> DataFrame:
        return X.swaps_evm(self.spark, self.folder)

    @cached_property
    def transfers(self) -> DataFrame:
        return X.transfers(self.spark, self.folder)

    @cached_property
    def xs(self) -> DataFrame:
        return self.sql(f"SELECT *, {STATS_SQL} FROM {{s}}", s=self.swaps)

    @cached_property
    def xe(self) -> DataFrame:
        return self.sql(f"SELECT *, {STATS_SQL} FROM {{s}}", s=self.evm)

    @cached_property
    def signals(self) -> DataFrame:
        return self.spark.sql(SIGNALS_SQL, swaps=self.swaps)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


def now():
    return F.lit(NOW).cast("timestamp")


@dataclass(frozen=True)
class Check:
    query: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: str
    longs: str


CHECKS: dict[str, Check] = {}


def check(name: str, query: Callable[[Tables], DataFrame], sql: str | None = None,
          doubles: str = "", longs: str = "") -> None:
    """Register a query. ``sql`` may use the tables of ``CTE``; its columns named in
    ``doubles`` are rounded and those in ``longs`` cast, like the Spark side."""
    if name in CHECKS:
        raise ValueError(name)
    CHECKS[name] = Check(query, sql, doubles, longs)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    df = CHECKS[name].query(Tables(spark, folder))
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) or (
                isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle(name: str) -> str | None:
    c = CHECKS[name]
    if c.sql is None:
        return None
    fixes = [f"round(CAST({d} AS DOUBLE), 6) + 0.0 AS {d}" for d in c.doubles.split()]
    fixes += [f"CAST({d} AS BIGINT) AS {d}" for d in c.longs.split()]
    body = c.sql.strip()
    head = CTE.rstrip()
    if body.upper().startswith("WITH "):
        # further CTEs of the check
        cut = body.rindex("\nFINAL ")
        head, body = head + ",\n" + body[5:cut], body[cut + 7:]
    replace = f" REPLACE ({', '.join(fixes)})" if fixes else ""
    return f"{head}\nSELECT *{replace} FROM (\n{body}\n)"
