"""Checks of the streaming variants: the event table as a file stream, all available input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft.checks.base import QUOTES, STATS_SQL, check
from tradeweft.checks.rollups import _CANDLE, _CD, _CL, _MOV, _STATS
from tradeweft.checks.state import _FIFO, _ONE
from tradeweft.operators.positions import position_legs
from tradeweft.session import scratch_dir
from tradeweft.sources import fixture as X
from tradeweft.sources.scans import read_csv_series
from tradeweft.streaming import rollups as R
from tradeweft.streaming import state as S


def _stream(t) -> DataFrame:
    """The derived swaps as a stream."""
    events = t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    swaps = t.spark.sql(X.SWAPS_SQL, events=events)
    return t.spark.sql(f"SELECT *, {STATS_SQL} FROM {{s}}", s=swaps)


def _new_folder(t) -> str:
    return f"{scratch_dir(t.spark)}/tradeweft/stream-{uuid.uuid4().hex}"


def _merged(t, name: str) -> DataFrame:
    folder = _new_folder(t)
    R.merge_batches(_stream(t), f"{folder}/out", f"{folder}/checkpoint", [name], QUOTES).awaitTermination()
    return R.read_rollup(t.spark, f"{folder}/out", name)


def _run(t, df: DataFrame) -> DataFrame:
    folder = _new_folder(t)
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


_BUYS = _CANDLE.replace("FROM evm", "FROM (SELECT * REPLACE (-amount_a AS amount_a, -amount_b AS amount_b) FROM swaps)")
check("t13_merged_candles", lambda t: _merged(t, "candles_1m").drop("open_key", "close_key"), _BUYS.format(unit="minute", cond=""), _CD, _CL)
check("t13_merged_pool_stats", lambda t: _merged(t, "pool_stats_1h"), f"WITH {_STATS}\nFINAL SELECT * FROM st", "volume_1h_usdc")
check("t13_merged_movers", lambda t: _merged(t, "daily_movers").drop("open_key", "close_key"),
      f"WITH {_MOV}\nFINAL SELECT * EXCLUDE (k0, k1) FROM mv", "open_price_usdc close_price_usdc volume_usdc")
check("t12_candles_stream", lambda t: _run(t, R.candles_stream(_stream(t), "1 hour", 1, "1 hour")).drop("open_key", "close_key"),
      "SELECT * FROM (" + _BUYS.format(unit="hour", cond="") + ") WHERE bucket_ts + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM swaps) - INTERVAL 1 HOUR", _CD, _CL)


def _positions(t) -> DataFrame:
    S.use_rocksdb(t.spark)
    legs = position_legs(_stream(t), 1, False, ["block_number"]).withColumnRenamed("block_number", "order_no")
    return _run(t, S.positions_stream(legs)).withColumnRenamed("order_no", "block_number")


check("t1_positions_stream", _positions,
      f"WITH {_FIFO.format(legs=_ONE)}\nFINAL SELECT account, token, n AS block_number, balance, cost, profit, wins, losses FROM fifo",
      "balance cost profit", "wins losses")


def _csv(t) -> DataFrame:
    path = f"{_new_folder(t)}/csv"
    t.swaps.select("block_number", "timestamp", F.when(F.col("block_number") % 9 > 0, F.col("token_a_usdc_price")).alias("price")) \
        .write.option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True)
    return read_csv_series(t.spark, path, "block_number BIGINT, timestamp TIMESTAMP, price DOUBLE")


check("s16_read_csv_series", _csv, "SELECT block_number, timestamp, token_a_usdc_price AS price FROM swaps WHERE block_number % 9 > 0", "price")
