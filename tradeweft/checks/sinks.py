"""Checks that write with the library's sinks, then read with its scans, and of the remaining streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.checks import chain as CC
from tradeweft.checks import rollups as CR
from tradeweft.checks import state as CS
from tradeweft.checks.base import check
from tradeweft.checks.streams import _merged, _new_folder, _run, _stream
from tradeweft.operators import decode_evm as DE
from tradeweft.operators import holders as H
from tradeweft.operators.dedup import union_protocols
from tradeweft.sources import scans as SC
from tradeweft.sources import tables as TB
from tradeweft.streaming import rollups as R
from tradeweft.streaming import state as S


def _logs(t):
    path = f"{_new_folder(t)}/logs"
    union_protocols(CC._v2(t), CC._v3(t)).write.parquet(path)
    return SC.read_logs(t.spark, path, [K.TOPIC_SWAP["uniswap_v3"]], ["0xC3", "0xc5"], (100, 9000))


check("s1_read_logs", lambda t: _logs(t).select("block_number", "address"),
      "SELECT event_id AS block_number, '0xc' || CAST(event_id % 12 AS VARCHAR) AS address FROM events WHERE event_id % 12 IN (3, 5) AND event_id BETWEEN 100 AND 9000")


def _transfers_read(t):
    path = f"{_new_folder(t)}/logs"
    CC._transfer_logs(t).write.parquet(path)
    return DE.decode_transfers(SC.read_transfer_logs(t.spark, path, ["0xc3"]))


check("s2_read_transfer_logs", lambda t: _transfers_read(t).select(*CC._trc), CC._TRSQL + " WHERE event_id % 12 = 3", "", "amount")


def _instructions(t):
    path = f"{_new_folder(t)}/instructions"
    CC._mixed(t).write.parquet(path)
    return SC.read_instructions(t.spark, path, ["raydium_clmm"], blocks=(0, 5000))


check("s3_read_instructions", lambda t: _instructions(t).groupBy("program_id").agg(F.count(F.lit(1)).alias("n")),
      f"""SELECT program_id, count(*) AS n FROM (SELECT '{K.PROGRAM_AMM['raydium_clmm']}' AS program_id, event_id FROM events WHERE event_id % 3 = 1
      UNION ALL SELECT '{K.PROGRAM_TOKEN}', event_id FROM events UNION ALL SELECT '{K.PROGRAM_LOADER}', event_id FROM events WHERE event_id % 50 = 3)
      WHERE event_id % 13 > 0 AND event_id <= 5000 GROUP BY 1""")


def _written(t, write, df, *args):
    path = f"{_new_folder(t)}/table"
    write(df, path, *args)
    return t.spark.read.parquet(path)


check("s7_write_swaps_evm", lambda t: _written(t, TB.write_swaps_evm, t.evm, "pool").select(
      "block_number", "pool_address", "account", "amount_a", "sign", "yyyymm"),
      "SELECT block_number, pool_address, account, amount_a, 1 AS sign, year(timestamp) * 100 + month(timestamp) AS yyyymm FROM evm", "amount_a", "sign yyyymm")
check("s8_write_swaps_solana", lambda t: _written(t, TB.write_swaps_solana, t.swaps.withColumn("instruction_address", F.array("log_index")), "account").select(
      "block_number", "account", "token_b_symbol", "pool_tvl_usdc", F.element_at("instruction_address", 1).alias("step")),
      "SELECT block_number, account, '[unknown]' AS token_b_symbol, pool_tvl AS pool_tvl_usdc, log_index AS step FROM tvl", "pool_tvl_usdc", "step")
check("s9_write_transfers", lambda t: _written(t, TB.write_transfers, t.transfers, "token").groupBy("token", "yyyymm").agg(
      F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")),
      "SELECT token, year(timestamp) * 100 + month(timestamp) AS yyyymm, count(*) AS n, sum(amount) AS amount FROM transfers GROUP BY 1, 2", "", "yyyymm amount")
check("s10_write_holders", lambda t: _written(t, TB.write_holders, CS._snap(t)).drop("yyyymm"),
      f"WITH {CS._HOLD}, {CS._SNAP}\nFINAL SELECT bucket_ts AS timestamp, token, holders FROM sn WHERE bucket_ts < (SELECT max(bucket_ts) FROM sn)")
check("s11_write_first_transfers", lambda t: _written(t, TB.write_first_transfers, H.first_transfers(t.transfers)).select("token", "timestamp", "transaction_index"),
      "SELECT token, min(timestamp) AS timestamp, arg_min(transaction_index, row(timestamp, transaction_index, log_index)) AS transaction_index FROM transfers GROUP BY 1",
      "", "transaction_index")


def _overlaps(t):
    """Files of the layout by pool, in order: how many begin before the last one of their month ends."""
    rows = _written(t, TB.write_table, t.swaps, "pool")
    key = F.struct("pool_address", "timestamp", "transaction_index", "log_index")
    files = rows.groupBy("yyyymm", F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    other = files.select("yyyymm", F.col("file").alias("file2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = files.join(other, "yyyymm").filter("file < file2 AND lo <= hi2 AND lo2 <= hi")
    return pairs.agg(F.count(F.lit(1)).alias("crossing")).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))


check("s12_files_by_pool", _overlaps, "SELECT 0 AS crossing, count(*) AS n FROM swaps", "", "crossing")

# --- the rest of the streams -----------------------------------------------------------------------
check("t13_merged_token_counts", lambda t: _merged(t, "token_swap_counts"),
      "SELECT token, sum(n) AS swap_count FROM (SELECT token_a AS token, count(*) AS n FROM swaps GROUP BY 1 UNION ALL SELECT token_b, count(*) FROM swaps GROUP BY 1) GROUP BY 1",
      "", "swap_count")
check("t13_merged_last_prices", lambda t: _merged(t, "last_prices").drop("order_key"),
      f"WITH {CR._LAST}\nFINAL SELECT token_a, token_b, pool_address, swap_timestamp, price_usdc FROM last", "price_usdc")
check("t13_merged_tokens", lambda t: _merged(t, "tokens_by_creation").select("token_address", "first_swap_date"),
      "SELECT token_a AS token_address, min(timestamp) AS first_swap_date FROM swaps GROUP BY 1")


def _hooked(t):
    folder = _new_folder(t)

    def hook(batch, batch_id):
        batch.groupBy("token_a").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")

    R.on_batch(_stream(t), hook, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/seen").groupBy("token_a").agg(F.sum("n").alias("n"))


check("x5_batch_hook", _hooked, "SELECT token_a, count(*) AS n FROM swaps GROUP BY 1", "", "n")


def _holder_stream(t):
    S.use_rocksdb(t.spark)
    folder = _new_folder(t)
    key = F.unix_seconds("timestamp") * 10_000_000 + F.col("transaction_index") * 10 + F.col("log_index")
    rows = t.transfers.withColumn("order_no", key)
    rows.write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    return _run(t, S.holder_changes_stream(stream)).groupBy("token").agg(F.sum("change").alias("holders"))


check("t7_holder_changes_stream", _holder_stream,
      f"WITH {CS._HOLD}\nFINAL SELECT token, sum(c) AS holders FROM ch GROUP BY 1", "", "holders")
