"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose input
and cores. Each query runs once to warm up code generation and once for the figure, with a
``noop`` sink so that all columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from tradeweft import checks
from tradeweft.session import drop_scratch, get_session

QUERIES = [
    "a1_candles_1m", "a3_rollup_candles", "a5_candles10s", "a9_best_quote_pools", "a10_last_best_prices",
    "a12_top_traders_evm", "a14_top_traders", "a17_top_movers", "a27_order_flow", "w13_rolling_best_pool",
    "j8_asof_join", "t1_fifo_positions", "t2_extend_positions", "t3_holder_counts", "t8_price_evm",
    "t9_price_quote", "m2_price_features", "m6_training_set", "b1_simulate_trades", "b4_performance",
    "p3_decode_v3_swaps", "j6_pair_swap_legs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                        spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    checks.names()
    times = {}
    for name in QUERIES:
        if only and name not in only.split(","):
            continue
        for _ in range(2):
            start = time.perf_counter()
            checks.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    drop_scratch(spark)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
