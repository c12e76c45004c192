"""Positions against a queue that is replayed row by row."""

import random

import pytest

from tradeweft.operators.ordered import by_size
from tradeweft.operators.positions import fifo_positions, open_lots

COLS = ("balance", "cost", "profit", "wins", "losses")


def replay(rows, state=None):
    state, out = {} if state is None else state, {}
    for account, token, n, buy, amount, price in rows:
        s = state.setdefault((account, token), [[], 0, 0])
        cost = profit = 0.0
        if amount and price:
            if buy:
                s[0].append([amount, price, 0.0])
            else:
                left = amount
                while left > 1e-10 and s[0]:
                    lot = s[0][0]
                    used = min(left, lot[0])
                    gain = used * price - used * lot[1]
                    cost, profit = cost + used * lot[1], profit + gain
                    lot[0], lot[2], left = lot[0] - used, lot[2] + gain, left - used
                    if lot[0] < 1e-10:
                        s[1 if lot[2] > 0 else 2] += 1
                        s[0].pop(0)
        out[n] = (sum(x[0] for x in s[0]), cost, profit, s[1], s[2])
    return out, state


def frame(spark, rows):
    return spark.createDataFrame(rows, "account string, token string, n int, is_buy boolean, amount double, price double")


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert [r[c] for c in COLS] == pytest.approx(want[r.n], abs=1e-6), r


@pytest.fixture(scope="module")
def history():
    rng = random.Random(11)
    return [("hot" if rng.random() < 0.5 else f"a{rng.randint(0, 12)}", f"t{rng.randint(0, 1)}", n,
             rng.random() < 0.52, float(rng.randint(0, 20)), float(rng.choice([0, 1, 1, 2, 3, 5])))
            for n in range(900)]


def test_random_histories(spark, history):
    check(fifo_positions(frame(spark, history), order=["n"]).collect(), replay(history)[0])


def test_snapshot_and_restart(spark, history):
    early, late = [r for r in history if r[2] < 450], [r for r in history if r[2] >= 450]
    want, state = replay(early)
    lots = open_lots(frame(spark, early), order=["n"]).persist()
    got = {}
    for r in lots.orderBy("lot_no").collect():
        got.setdefault((r.account, r.token), []).append((r.amount, r.price, r.realized_profit))
    for key, (queue, _, _) in state.items():
        flat = [x for lot in got[key] for x in lot]
        assert flat == pytest.approx([x for lot in queue for x in lot] or [0, 0, 0], abs=1e-6)
    want, _ = replay(late, state)
    check(fifo_positions(frame(spark, late), order=["n"], opening=lots).collect(), want)


@pytest.mark.parametrize("rows", [
    [(1, False, 5.0, 2.0), (2, True, 3.0, 2.0), (3, False, 9.0, 4.0), (4, True, 1.0, 1.0)],      # over-sell
    [(1, True, 4.0, 2.0), (2, False, 4.0, 2.0)],                                                 # closed at zero
    [(1, True, 0.0, 2.0), (2, True, 2.0, 0.0), (3, False, 1.0, 3.0)],                             # ignored rows
    [(1, True, 9.0, 1.0), (2, False, 2.0, 2.0), (3, False, 3.0, 0.5), (4, False, 4.0, 3.0)],      # one lot, three sells
    [(1, True, 1.0, 1.0), (2, True, 1.0, 2.0), (3, True, 1.0, 3.0), (4, False, 2.5, 2.0), (5, False, 0.5, 9.0)],
    [(1, False, 1.0, 1.0), (2, False, 1.0, 1.0)],                                                # sells only
])
def test_edge_histories(spark, rows):
    data = [("a", "t", *r) for r in rows]
    check(fifo_positions(frame(spark, data), order=["n"]).collect(), replay(data)[0])


def test_wide_amounts_and_dust(spark):
    """10^27 units and 10^-18 units, in tokens of their own, in one token, and beside ordinary ones."""
    wide = [("a", "w", 1, True, 1e27, 2e-9), ("a", "w", 2, False, 4e26, 3e-9), ("a", "w", 3, False, 6e26, 1e-9)]
    dust = [("a", "d", 4, True, 3e-18, 2e15), ("a", "d", 5, False, 1e-18, 4e15), ("a", "d", 6, False, 2e-18, 5e15)]
    both = [("a", "b", 7, True, 2.5, 2.0), ("a", "b", 8, True, 1e-13, 3.0), ("a", "b", 9, False, 2.5, 4.0)]
    plain = [("a", "p", 10, True, 0.1, 2.0), ("a", "p", 11, True, 0.2, 2.0), ("a", "p", 12, False, 0.3, 3.0)]
    odd = [("a", "p", 13, True, float("inf"), 2.0), ("a", "p", 14, True, float("nan"), 2.0)]
    got = {r.n: r for r in fifo_positions(frame(spark, wide + dust + both + plain + odd), order=["n"]).collect()}
    rel = lambda n: [getattr(got[n], c) for c in COLS]
    assert rel(1) == pytest.approx([1e27, 0, 0, 0, 0])
    assert rel(2) == pytest.approx([6e26, 8e17, 4e17, 0, 0])
    assert rel(3) == pytest.approx([0, 1.2e18, -6e17, 0, 1])      # the lot ends with a loss of 2e17
    assert rel(4)[0] == pytest.approx(3e-18, rel=1e-12)
    assert rel(5)[:3] == pytest.approx([2e-18, 0.002, 0.002], rel=1e-9, abs=0)
    assert rel(6) == pytest.approx([0, 0.004, 0.006, 1, 0], rel=1e-9)
    assert rel(8)[0] - 2.5 == pytest.approx(1e-13, rel=1e-2)
    assert rel(9)[0] == pytest.approx(1e-13, rel=1e-12, abs=0) and rel(9)[1:] == pytest.approx([5, 5, 1, 0])
    assert rel(12) == pytest.approx([0, 0.6, 0.3, 2, 0]) and rel(14)[0] == 0
    lots = {r.token: r for r in open_lots(frame(spark, wide[:2] + dust[:2] + both), order=["n"]).collect()}
    assert lots["w"].amount == pytest.approx(6e26) and lots["w"].price == pytest.approx(2e-9, rel=1e-9)
    assert lots["d"].amount == pytest.approx(2e-18, rel=1e-9) and lots["d"].price == pytest.approx(2e15)
    assert lots["b"].amount == pytest.approx(1e-13, rel=1e-9)


def test_wide_amounts_over_several_chunks(spark):
    rows = [("a", "w", n, n % 3 > 0, 1e26 * (n % 7 + 1), 1e-9 * (n % 5 + 1)) for n in range(60)]
    want, _ = replay([(a, t, n, buy, amount / 1e20, price * 1e20) for a, t, n, buy, amount, price in rows])
    old = spark.conf.get("tradeweft.chunk.bytes", None)
    spark.conf.set("tradeweft.chunk.bytes", "1")
    try:
        got = fifo_positions(frame(spark, rows), order=["n"]).collect()
    finally:
        spark.conf.unset("tradeweft.chunk.bytes") if old is None else spark.conf.set("tradeweft.chunk.bytes", old)
    for r in got:
        # money is about 1e17, where the doubles of the replay end at 10
        assert [r.balance / 1e20, r.cost, r.profit] == pytest.approx(want[r.n][:3], rel=1e-9, abs=1e3)
        assert r.wins + r.losses == sum(want[r.n][3:])


def test_large_and_usual_keys_together(spark, history):
    """The hot account goes into chunks, the others are partitioned by key; both give what the replay gives."""
    old = spark.conf.get("tradeweft.chunk.bytes", None)
    spark.conf.set("tradeweft.chunk.bytes", str(100 * 256))  # 100 rows
    try:
        parts = by_size(frame(spark, history), ["account", "token"], ["n"])
        kinds = {t.whole: {r.account for r in t.df.select("account").distinct().collect()} for t in parts}
        got = fifo_positions(frame(spark, history), order=["n"]).collect()
        lots = open_lots(frame(spark, history), order=["n"]).collect()
    finally:
        spark.conf.unset("tradeweft.chunk.bytes") if old is None else spark.conf.set("tradeweft.chunk.bytes", old)
    assert kinds[False] == {"hot"} and kinds[True] == {r[0] for r in history} - {"hot"}
    want, state = replay(history)
    check(got, want)
    left = {}
    for r in lots:
        left[r.account, r.token] = left.get((r.account, r.token), 0) + r.amount
    assert left == pytest.approx({k: sum(x[0] for x in s[0]) for k, s in state.items()}, abs=1e-6)


def test_usual_keys_are_shuffled_once(spark, history, folder):
    frame(spark, history).write.parquet(f"{folder}/legs")
    plan = fifo_positions(spark.read.parquet(f"{folder}/legs"), order=["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert sum("FileScan" in line and "account" in line for line in plan.split("\n")) == 1


def test_rows_equal_in_the_order(spark):
    """Of two sells at one place in the order the one that finds a balance comes first; the other has its wins."""
    rows = [("a", "t", 1, True, 5.0, 1.0)] + [("a", "t", 2, False, 5.0, 2.0)] * 2 + [("b", "t", 3, True, 1.0, 1.0)]
    got = fifo_positions(frame(spark, rows), order=["n"]).collect()
    assert sorted((r.n, r.cost, r.profit, r.wins, r.losses) for r in got) == [
        (1, 0, 0, 0, 0), (2, 0, 0, 1, 0), (2, 5, 5, 1, 0), (3, 0, 0, 0, 0)]
