"""Quantiles of ranges of time and size against a scan for every range."""

import time as clock

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeweft.operators.features import slippage_profile
from tradeweft.operators.range_quantiles import range_quantiles

LEVELS = (0.0, 0.2, 0.5, 1.0)


def brute(time, size, value, times, sizes):
    out = []
    for a, b, c, d in zip(*times, *sizes):
        own = value[(time >= a) & (time <= b) & (size >= c) & (size <= d)]
        out.append(np.quantile(own, LEVELS) if len(own) else [np.nan] * len(LEVELS))
    return np.array(out)


@pytest.mark.parametrize("n, ties", [(1, 1), (2, 1), (7, 3), (64, 5), (65, 1000), (500, 9), (500, 10 ** 6)])
def test_random_ranges(n, ties):
    rng = np.random.default_rng(n + ties)
    time, size, value = (rng.integers(0, ties, n).astype(float) for _ in range(3))
    ends = np.sort(rng.integers(-2, ties + 2, (2, 80)), axis=0).astype(float)
    spans = np.sort(rng.integers(-2, ties + 2, (2, 80)), axis=0).astype(float)
    got = range_quantiles(time, size, value, tuple(ends), tuple(spans), LEVELS)
    np.testing.assert_allclose(got, brute(time, size, value, ends, spans), rtol=1e-12)


def test_nothing_to_find():
    none, one = np.array([]), np.array([1.0])
    assert np.isnan(range_quantiles(none, none, none, (one, one), (one, one), LEVELS)).all()
    assert range_quantiles(one, one, one, (none, none), (none, none), LEVELS).shape == (0, len(LEVELS))
    assert np.isnan(range_quantiles(one, one, one, (one, one - 1), (one, one), LEVELS)).all()  # bounds in the wrong order


def test_a_busy_pool_hour_is_no_product():
    rng = np.random.default_rng(3)
    n = 100_000  # 10^10 pairs
    time, size, value = rng.random(n) * 7200, rng.random(n) * 100, rng.random(n)
    at, own = rng.random(n) * 3600 + 3600, rng.random(n) * 100
    start = clock.time()
    got = range_quantiles(time, size, value, (at - 3600, at), (own / 2, own * 2), (0.2, 0.5))
    assert clock.time() - start < 60
    some = slice(0, 20)
    want = brute(time, size, value, (at[some] - 3600, at[some]), (own[some] / 2, own[some] * 2))[:, 1:3]
    np.testing.assert_allclose(got[some], want)


def test_profile_of_odd_rows(spark):
    """Nulls, an hour without trades, hours that meet, trades at both ends of the hour."""
    swaps = spark.createDataFrame(
        [("t", "p", "2024-01-01 10:00:00", 10.0, 1.0), ("t", "p", "2024-01-01 10:30:00", 20.0, 3.0), ("t", "p", "2024-01-01 11:00:00", 5.0, None),
         ("t", "p", "2024-01-01 10:59:59", 9.0, float("nan")), ("t", "p", "2024-01-01 10:40:00", None, 7.0), (None, "p", "2024-01-01 10:40:00", 9.0, 7.0),
         ("u", "p", "2024-01-01 10:40:00", 10.0, -7.0)],
        "token_a string, pool_address string, timestamp string, amount_b double, slippage_pct double") \
        .withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "token_b_usdc_price": F.lit(1.0)})
    signals = spark.createDataFrame(
        [(1, "t", "p", "2024-01-01 11:00:00", 10.0), (2, "t", "p", "2024-01-01 11:00:01", 10.0), (3, "t", "p", "2024-01-01 12:30:00", 10.0),
         (4, "u", "p", "2024-01-01 10:40:00", 10.0), (5, None, "p", "2024-01-01 10:40:00", 10.0), (6, "t", "p", "2024-01-01 11:00:00", None),
         (7, "t", "q", "2024-01-01 11:00:00", 10.0)],
        "signal_id int, token string, pool string, timestamp string, size_usdc double").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = {r.signal_id: (r.slippage_low, r.slippage_high) for r in slippage_profile(signals, swaps).collect()}
    assert set(got) == {1, 2, 4} and got[4] == (7.0, 7.0)
    assert got[1] == pytest.approx(tuple(np.quantile([1, 3, 0, 0], [0.2, 0.5])))
    assert got[2] == pytest.approx(tuple(np.quantile([3, 0, 0], [0.2, 0.5])))
    assert slippage_profile(signals.filter("false"), swaps).count() == slippage_profile(signals, swaps.filter("false")).count() == 0
