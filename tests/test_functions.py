"""Column functions on hand-written edge values."""

import pytest
from pyspark.sql import functions as F

from tradeweft.functions import amm, keys, market, num
from tradeweft.functions import hexwords as H
from tradeweft.operators import candles as C
from tradeweft.operators import decode_evm as DE
from tradeweft.operators import dedup as D
from tradeweft.operators import pools as PL

EDGES = [0, 1, -1, 2 ** 63, -2 ** 63, 2 ** 64 - 1, 2 ** 64, -2 ** 64, 10 ** 38 - 1, 10 ** 38, -10 ** 38, 2 ** 127 - 1, -2 ** 127,
         2 ** 160 + 12345, 2 ** 255 - 1, -2 ** 255, 123456789012345678901234567890]


def words(spark, values):
    return spark.createDataFrame([(str(v), format(v % 2 ** 256, "064x")) for v in values], "v string, w string")


def test_signed_words(spark):
    for r in words(spark, EDGES).select("v", H.int_string(F.col("w")).alias("t"), H.int_double(F.col("w")).alias("d")).collect():
        assert r.t == r.v
        assert r.d == pytest.approx(float(int(r.v)), rel=1e-12)


def test_unsigned_words(spark):
    values = [v for v in EDGES if v >= 0] + [2 ** 256 - 1]
    for r in words(spark, values).select("v", H.uint_string(F.col("w")).alias("t")).collect():
        assert r.t == r.v


def test_v4_amounts_are_negated_and_bad_transfers_dropped(spark):
    from tradeweft import constants as K
    pad = lambda v: format(v % 2 ** 256, "064x")
    log = (1, "0xp", K.TOPIC_SWAP["uniswap_v4"], [K.TOPIC_SWAP["uniswap_v4"], "0x" + pad(9), "0x" + pad(5)],
           "0x" + pad(-7) + pad(2 ** 100) + pad(1) + pad(2) + pad(-3))
    schema = "block_number long, address string, topic0 string, topics array<string>, data string"
    extra = {c: F.lit(0) for c in ("transaction_index", "log_index")} | {
        "timestamp": F.lit("2024-01-01").cast("timestamp"), "transaction_hash": F.lit("h")}
    r = DE.decode_v4_swaps(spark.createDataFrame([log], schema).withColumns(extra)).first()
    assert (r.amount_a_text, r.amount_b_text, r.pool_tick, r.recipient) == ("7", str(-2 ** 100), -3, None)
    t = K.TOPIC_TRANSFER
    rows = [(1, "0xT", t, [t, "0x" + pad(1), "0x" + pad(2)], "0x" + pad(6)), (2, "0xT", t, [t, "0x" + pad(1), "0x" + pad(2)], "0x06"),
            (3, "0xT", t, [t, "0x" + pad(1), "0x" + pad(2), "0x" + pad(3)], "0x")]
    got = DE.decode_transfers(spark.createDataFrame(rows, schema).withColumns(extra)).collect()
    assert [(r.block_number, int(r.amount)) for r in got] == [(1, 6)]


def test_constant_product_is_exact_and_falls_back(spark):
    cases = [(10 ** 6, 10 ** 12, 3 * 10 ** 12), (10 ** 18, 10 ** 19, 10 ** 18), (10 ** 20, 10 ** 21, 10 ** 22)]
    df = spark.createDataFrame([(str(a), str(b), str(c)) for a, b, c in cases], "a string, ri string, ro string") \
        .select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in ("a", "ri", "ro")])
    got = df.select(amm.cp_exact_in(F.col("a"), F.col("ri"), F.col("ro")).alias("o")).collect()
    for r, (a, ri, ro) in zip(got, cases):
        assert r.o == pytest.approx(a * 9975 * ro // (ri * 10000 + a * 9975), rel=1e-12)


def test_path_order_like_arrays(spark):
    paths = [[0], [0, 0], [0, 1, 2], [0, 1], [1], [10, 3], [2], [63, 1, 1, 1, 1]]
    df = spark.createDataFrame([(p,) for p in paths], "p array<int>")
    by_key = [r.p for r in df.orderBy(keys.packed_path(F.col("p"))).collect()]
    assert by_key == sorted(paths)


def test_division_decimal_text_and_bucket_edges(spark):
    df = spark.createDataFrame([(5, 0, 3), (-5, 2, 0), (-123456, 4, 3)], "x long, y long, d int")
    got = df.select(num.safe_div(F.col("x"), F.col("y")).alias("q"), num.decimal_string(F.col("x"), F.col("d")).alias("s")).collect()
    assert [(r.q, r.s) for r in got] == [(None, "0.005"), (-2.5, "-5"), (-30864.0, "-123.456")]
    df = spark.createDataFrame([(7, 1e5), (8, 5e4), (400, 2e7), (30, None)], "a int, v double")
    assert [r.b for r in df.select(market.bucket_of(F.col("a"), F.col("v")).alias("b")).collect()] == \
        ["new_tokens", "new_tokens", "blue_chip", "new_tokens"]


SWAP = ("timestamp string, pool_address string, token_a string, token_b string, dex string, amount_a double, amount_b double, "
        "token_a_usdc_price double, token_b_usdc_price double, transaction_index int, log_index int, sign int")


def _swaps(spark, rows):
    return spark.createDataFrame(rows, SWAP).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_candle_order_at_equal_time_and_rollback(spark):
    at = "2024-01-01 00:00:05"
    rows = [(at, "p", "A", "Q", "d", -1.0, 2.0, 2.0, 1.0, 7, 9, 1), (at, "p", "A", "Q", "d", -1.0, 9.0, 9.0, 1.0, 7, 10, 1),
            (at, "p", "A", "Q", "d", 1.0, -3.0, 3.0, 1.0, 6, 99, 1)]
    r = C.candles(_swaps(spark, rows), "1 minute").first()
    assert (r.open, r.close, r.high, r.swap_count, r.buy_count) == (3.0, 9.0, 9.0, 3, 2)
    # taking back the high: collapse first, then aggregate
    both = _swaps(spark, rows + [(*rows[1][:-1], -1)])
    clean = D.collapse(both, ["timestamp", "transaction_index", "log_index"])
    r = C.candles(clean, "1 minute").first()
    assert (r.high, r.close, r.swap_count) == (3.0, 2.0, 2)
    assert D.collapse(_swaps(spark, rows).unionByName(_swaps(spark, [(*x[:-1], -1) for x in rows])),
                      ["timestamp", "transaction_index", "log_index"]).isEmpty()


def test_last_price_prefers_best_pool_and_breaks_ties(spark):
    at = "2024-01-01 00:00:0"
    rows = [(at + "1", "p1", "A", "Q", "d", 1.0, -5.0, 5.0, 1.0, 0, 0, 1), (at + "2", "p2", "A", "Q", "d", 1.0, -5.0, 6.0, 1.0, 0, 0, 1),
            (at + "3", "p2", "B", "Q", "d", 1.0, -5.0, 7.0, 1.0, 0, 0, 1)]
    s = _swaps(spark, rows)
    best = PL.best_quote_pools(PL.pool_stats_1h(s, ["Q"]), "2024-01-01", "2024-01-02")
    assert {r.token_a: r.pool_address for r in best.collect()} == {"A": "p1", "B": "p2"}
    only_a = PL.last_best_prices(PL.last_prices(s, ["Q"]), best.filter("token_a = 'A'")).collect()
    assert {(r.token, r.pool_address, r.best_pool_address, r.price_usdc) for r in only_a} == {("A", "p1", "p1", 5.0), ("B", "p2", None, 7.0)}
