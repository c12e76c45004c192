"""Holder counts against a sequential replay, with overdraws and burns."""

import random
from decimal import Decimal

import pytest

from tradeweft.constants import ZERO_ADDRESS as ZERO
from tradeweft.operators import holders as H

ORDER = ["n"]


def replay(rows):
    first, bal, count, out = {}, {}, {}, {}
    for token, src, dst, amount, n in rows:
        first.setdefault(token, src)
        if first[token] != ZERO:
            continue
        holders = count.get(token, 0)
        if src != ZERO:
            old = bal.get((token, src), 0)
            if old - amount < 0:
                continue
            holders -= old > 0 and old == amount
            bal[token, src] = old - amount
        if dst != ZERO:
            old = bal.get((token, dst), 0)
            holders += old == 0 and amount > 0
            bal[token, dst] = old + amount
        count[token] = holders
        out[token, n] = holders
    return out


def frame(spark, rows, kind="int"):
    cast = {"int": int, "string": str, "decimal(38,0)": Decimal}[kind]
    return spark.createDataFrame([(t, s, d, cast(a), n) for t, s, d, a, n in rows],
                                 f"token string, from_address string, to_address string, amount {kind}, n int")


@pytest.mark.parametrize("kind,scale", [("string", 10**60 + 7), ("decimal(38,0)", 10**36 + 3), ("string", 1)])
def test_wide_amounts(spark, kind, scale):
    """Amounts of up to 256 bits, with rejections and balances that reach zero exactly."""
    rng = random.Random(scale)
    rows = []
    for n in range(120):
        src = ZERO if n < 10 or rng.random() < 0.15 else f"a{rng.randint(0, 5)}"
        dst = ZERO if rng.random() < 0.1 else f"a{rng.randint(0, 5)}"
        rows.append((f"t{n % 2}", src, dst, rng.randint(0, 4) * scale + (rng.random() < 0.1), n))
    got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows, kind), order=ORDER).collect()}
    assert got == replay(rows)


def test_replay_over_chunk_borders(spark):
    """One address with most rows, rejections that flip each other, many chunks."""
    rng = random.Random(5)
    rows = [("t", ZERO, "hub", 40, 0)]
    for n in range(1, 200):
        src, dst = ("hub", f"a{rng.randint(0, 3)}") if rng.random() < 0.5 else (f"a{rng.randint(0, 3)}", "hub")
        rows.append(("t", src, dst, rng.randint(1, 30), n))
    got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows), order=ORDER).collect()}
    assert got == replay(rows) and len(got) < 190


@pytest.mark.parametrize("seed", [2])
def test_strict_counts_match_replay(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(250):
        token = "hot" if rng.random() < 0.5 else f"t{rng.randint(0, 3)}"
        src = ZERO if n < 12 or rng.random() < 0.15 else f"a{rng.randint(0, 6)}"
        dst = ZERO if rng.random() < 0.1 else f"a{rng.randint(0, 6)}"
        rows.append((token, src, dst, rng.randint(1, 9), n))
    got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows), order=ORDER).collect()}
    assert got == replay(rows)


@pytest.mark.parametrize("rows", [
    [("t", ZERO, "a", 5, 1), ("t", "a", ZERO, 5, 2)],
    [("t", ZERO, "a", 5, 1), ("t", "a", "a", 5, 2), ("t", "a", "b", 5, 3)],
    [("t", ZERO, "a", 5, 1), ("t", "a", "b", 9, 2), ("t", "b", "c", 1, 3), ("t", "a", "b", 5, 4)],
    [("t", "x", "a", 5, 1), ("t", ZERO, "a", 5, 2)],
])
def test_edges(spark, rows):
    got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows), order=ORDER).collect()}
    assert got == replay(rows)


def test_compat_keeps_the_count_on_an_emptying_burn(spark):
    rows = [("t", ZERO, "a", 5, 1), ("t", "a", ZERO, 5, 2), ("t", ZERO, "b", 1, 3)]
    counts = H.holder_counts(frame(spark, rows), order=ORDER, compat=True)
    assert [r.holders for r in counts.orderBy("n").collect()] == [1, 1, 2]


def test_balances_only_count_tokens_created_in_range(spark):
    b = spark.createDataFrame([(1, None, "t", 0, 5), (2, "t", None, 5, 0), (2, None, "t", 0, 1), (2, None, "old", 0, 1), (3, None, "t", 0, 2)],
                              "block_number int, pre_mint string, post_mint string, pre_amount int, post_amount int")
    inits = spark.createDataFrame([("t", 1)], "token string, block_number int")
    got = [(r.token, r.block_number, r.holders) for r in H.holder_counts_balances(b, inits).orderBy("block_number").collect()]
    assert got == [("t", 1, 1), ("t", 2, 1), ("t", 3, 2)]


def counted(spark, rows):
    """The rows as a frame, and how many of them have been worked out."""
    seen, base = spark.sparkContext.accumulator(0), frame(spark, rows)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return base.mapInArrow(run, base.schema), seen


@pytest.mark.parametrize("strict", [True, False])
def test_transfers_are_worked_out_once(spark, strict):
    rows = [("t", ZERO, "a", 5, 1), ("t", "a", "b", 2, 2), ("u", ZERO, "a", 1, 3)]
    transfers, seen = counted(spark, rows)
    got = {(r.token, r.n): r.holders for r in H.holder_counts(transfers, strict, order=ORDER).collect()}
    assert got == replay(rows) and seen.value == len(rows)


def test_counts_are_worked_out_once_for_closed_snapshots(spark):
    counts = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, n) AS timestamp, 't' AS token, 7 AS holders, n FROM VALUES (1), (2), (3) v(n)")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    snaps = H.holder_snapshots(counts.mapInArrow(run, counts.schema), "1 day", order=ORDER)
    assert [r.bucket_ts.day for r in snaps.orderBy("bucket_ts").collect()] == [2, 3] and seen.value == 3


def test_only_addresses_that_may_change_are_replayed(spark, monkeypatch):
    """b overdraws without a's units, and c without those of b; d sends nothing, and e has enough."""
    rows = [("t", ZERO, "a", 5, 1), ("t", ZERO, "e", 9, 2), ("t", "a", "b", 9, 3), ("t", "b", "c", 9, 4),
            ("t", "c", "d", 9, 5), ("t", "e", "d", 3, 6)]
    seen, replayed = spark.sparkContext.accumulator(0), H._replay

    def counting(*args):
        run = replayed(*args)

        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return lambda batches: run(count(batches))

    monkeypatch.setattr(H, "_replay", counting)
    got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows), order=ORDER).collect()}
    assert got == replay(rows) and seen.value == 6  # a, b and c, two legs each


def test_one_replay_serves_receivers_that_send_nothing(spark, monkeypatch):
    """Rejections that reach no other sender are settled by the first pass: its rows are neither placed nor replayed again."""
    def never(*_):
        raise AssertionError("replayed again")

    monkeypatch.setattr(H, "_settled", never)
    rows = [("t", ZERO, "a", 5, 1), ("t", ZERO, "e", 9, 2), ("t", "a", "b", 9, 3), ("t", "a", "b", 4, 4), ("t", "a", "c", 3, 5),
            ("t", "e", "c", 9, 6), ("u", ZERO, "a", 1, 7), ("u", "a", "b", 1, 8)]
    for kind in ("int", "string", "decimal(38,0)"):
        wide = [(t, s, d, a * 10 ** (40 if kind == "string" else 0), n) for t, s, d, a, n in rows]
        got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, wide, kind), order=ORDER).collect()}
        assert got == replay(rows) and len(got) == 6


@pytest.mark.parametrize("kind,scale", [("string", 10**60 + 7), ("decimal(38,0)", 1)])
def test_large_and_usual_addresses_reject_each_other(spark, kind, scale):
    """Most addresses are walked whole, one goes into chunks; a key goes over several batches of rows."""
    rng, rows = random.Random(8), [("t", ZERO, "hub", 60 * scale, 0)]
    for n in range(1, 400):
        a, b = f"a{rng.randint(0, 30)}", f"a{rng.randint(0, 30)}"
        src, dst = rng.choice([("hub", a), (a, "hub"), (a, b), (ZERO, a)])
        rows.append(("t", src, dst, rng.randint(1, 20) * scale, n))
    settings = {"tradeweft.chunk.bytes": str(60 * 256), "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {(r.token, r.n): r.holders for r in H.holder_counts(frame(spark, rows, kind), order=ORDER).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == replay(rows) and len(got) < 390
