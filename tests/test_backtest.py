"""Trade exits and labels against loops."""

import random
from datetime import datetime, timedelta

import pytest

from tradeweft.operators.backtest import performance, simulate_trades
from tradeweft.operators.labels import drawdown_labels

T0 = datetime(2024, 1, 1)
SIG = "signal_id int, token string, pool string, dex string, timestamp timestamp, entry_price double, size_usdc double, bucket string"
CAN = "token string, pool string, bucket_ts timestamp, close_price double, atr_20 double"
PRE = "signal_id int, bucket_ts timestamp, upside_pred double, drawdown_prob double"


def loop(prices, atrs, preds, entry):
    peak, worst, reason, last = entry, 0.0, "timeout", None
    for i, p in enumerate(prices):
        peak = max(peak, p)
        worst = max(worst, (peak - p) / peak)
        last, sell = i, False
        if preds[i][0] < 0.008 and preds[i][1] > 0.4:
            sell, reason = True, "model"
        if atrs[i] and p <= peak - 2.5 * atrs[i]:
            sell, reason = True, "stop_loss"
        if p / entry - 1 < -0.05:
            sell, reason = True, "stop_loss"
        if sell:
            break
    else:
        reason = "timeout"
    return last, worst, reason


def test_exits_match_loop(spark):
    rng = random.Random(4)
    signals, candles, preds, want = [], [], [], {}
    for i in range(60):
        n = rng.randint(1, 40)
        prices = [1 + rng.uniform(-0.04, 0.06) + 0.002 * k * rng.choice([-1, 1]) for k in range(n)]
        atrs = [rng.choice([None, 0.01, 0.03]) for _ in range(n)]
        pred = [(rng.choice([0.001, 0.02]), rng.choice([0.1, 0.1, 0.5])) for _ in range(n)]
        at = [T0 + timedelta(minutes=3 * k) for k in range(n)]
        signals.append((i, f"t{i}", "p", "orca", T0, 1.0, 100.0, "new_tokens"))
        candles += [(f"t{i}", "p", a, p, x) for a, p, x in zip(at, prices, atrs)]
        preds += [(i, a, *q) for a, q in zip(at, pred)]
        if n >= 2:
            last, worst, reason = loop(prices, atrs, pred, 1.0)
            want[i] = (at[last], prices[last], worst, reason)
    got = simulate_trades(spark.createDataFrame(signals, SIG), spark.createDataFrame(candles, CAN), spark.createDataFrame(preds, PRE)).collect()
    assert {r.signal_id for r in got} == set(want)
    for r in got:
        at, price, worst, reason = want[r.signal_id]
        assert (r.exit_time, r.exit_reason) == (at, reason)
        assert (r.exit_price, r.max_drawdown) == (pytest.approx(price), pytest.approx(worst))


def test_prices_after_the_horizon_do_not_count(spark):
    signals = [(1, "t", "p", "orca", T0, 1.0, 100.0, "new_tokens")]
    candles = [("t", "p", T0 + timedelta(hours=h), 1.0 + h / 100, None) for h in (0, 1, 2, 3)]
    r = simulate_trades(spark.createDataFrame(signals, SIG), spark.createDataFrame(candles, CAN)).first()
    assert (r.exit_price, r.exit_reason, r.holding_time_hours) == (1.02, "timeout", 2.0)


def test_drawdown_labels_match_loop(spark):
    rng = random.Random(9)
    data = [(i, T0 + timedelta(minutes=k), rng.uniform(-0.1, 0.1)) for i in range(40) for k in range(rng.randint(1, 12))]
    got = drawdown_labels(spark.createDataFrame(data, "signal_id int, timestamp timestamp, net_return_current double")).collect()
    for r in got:
        future = [x for i, at, x in data if i == r.signal_id and at > r.timestamp]
        peak, worst = r.net_return_current, 0.0
        for x in future:
            peak = max(peak, x)
            worst = max(worst, peak - x)
        assert r.max_future_drawdown == pytest.approx(worst)
        assert r.drawdown_label == int(worst > 0.05)


def test_performance_of_losing_trades_only(spark):
    rows = [(-0.1, 0.2, 1.0, "stop_loss"), (-0.2, 0.3, 2.0, "model")]
    p = performance(spark.createDataFrame(rows, "net_return double, max_drawdown double, holding_time_hours double, exit_reason string")).first()
    assert p.avg_win == 0 and p.best_win == 0 and p.profit_factor == 0
    assert p.total_return == pytest.approx(0.9 * 0.8 - 1)
    assert p.var_95 == pytest.approx(-0.195) and p.cvar_95 == pytest.approx(-0.2)
