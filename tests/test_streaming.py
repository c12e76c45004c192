"""A stream over all available input gives the batch result."""

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tradeweft.operators import candles as C
from tradeweft.operators import holders as H
from tradeweft.operators import positions as PO
from tradeweft.sources import fixture as X
from tradeweft.streaming import rollups as R
from tradeweft.streaming import state as S


@pytest.fixture(scope="module")
def source(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("swaps"))
    s = X.swaps(spark, tables).withColumns({"token_a_symbol": F.concat(F.lit("S_"), "token_a"),
                                           "token_a_creation_date": F.lit("2023-01-01").cast("timestamp")})
    for lo, hi in ((0, 300), (300, 700), (700, 10 ** 9)):
        s.filter(F.col("block_number").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    return batch, lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    cols = sorted(b.columns)
    r = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes])
    return r(a).exceptAll(r(b)).isEmpty() and r(b).exceptAll(r(a)).isEmpty()


def run(df, folder, name):
    q = df.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
        "checkpointLocation", f"{folder}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def test_merged_rollups(spark, source, folder):
    batch, stream = source
    R.merge_batches(stream(), f"{folder}/out", f"{folder}/cp", quotes=X.QUOTES).awaitTermination()
    for name, (partial, _) in R.ROLLUPS.items():
        assert same(R.read_rollup(spark, f"{folder}/out", name), partial(batch, X.QUOTES)), name


def test_candles(source, folder):
    batch, stream = source
    got = run(R.candles_stream(stream(), "1 hour", 1, "1 hour"), folder, "candles")
    want = C.candles(batch, "1 hour", 1)
    closed = want.filter(F.col("bucket_ts") < got.agg(F.max("bucket_ts")).first()[0])
    assert closed.count() > 900
    assert same(got.join(closed.select("pool_address", "token", "bucket_ts"), ["pool_address", "token", "bucket_ts"], "left_semi"), closed)


def test_positions(source, folder):
    batch, stream = source
    legs = lambda s: PO.position_legs(s, 1, False, ["block_number"])
    got = run(S.positions_stream(legs(stream()).withColumnRenamed("block_number", "order_no")), folder, "positions")
    want = PO.fifo_positions(legs(batch), order=["block_number"]).withColumnRenamed("block_number", "order_no")
    assert same(got, want.select(*got.columns))


def test_holders_and_first_transfers(spark, tables, folder):
    t = X.transfers(spark, tables).withColumn("order_no", F.unix_seconds("timestamp") * 1_000_000 + F.col("transaction_index") * 10 + F.col("log_index"))
    for lo, hi in ((0, 7e14), (7e14, 1e18)):
        t.filter((F.col("order_no") >= lo) & (F.col("order_no") < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = run(S.holder_changes_stream(stream()), folder, "changes").groupBy("token").agg(F.sum("change").alias("holders"))
    want = H.holder_deltas(t).groupBy("token").agg(F.sum("change").alias("holders"))
    assert same(got, want)
    first = run(S.first_transfers_stream(stream()), folder, "first")
    assert same(first, H.first_transfers(t.select("token", "from_address", "to_address", "order_no"), ["order_no"]))


def test_duplicate_guard(source, folder):
    batch, stream = source
    doubled = stream().unionByName(stream())
    got = run(R.drop_repeats(doubled, ["block_number"], lateness="60 days"), folder, "unique")
    assert got.count() == batch.count()


class _Held:
    """State of one key that counts its calls."""

    def __init__(self):
        self.value, self.lots, self.calls = None, {}, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.lots.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.lots[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.lots[key]


def test_state_is_read_and_written_once_a_batch():
    """Lots that are bought and sold inside a batch never reach the state."""
    held, processor = _Held(), S._Positions()
    processor.init(held)
    leg = lambda no, buy, amount: Row(order_no=no, is_buy=buy, amount=amount, price=2.0)
    out = list(processor.handleInputRows(("a", "t"), iter([leg(no, no % 2 == 0, 1.0) for no in reversed(range(100))]), None))
    assert [r.order_no for r in out] == list(range(100)) and out[-1].balance == 0 and held.calls == 2 and not held.lots
    list(processor.handleInputRows(("a", "t"), iter([leg(100, True, 3.0), leg(101, True, 3.0)]), None))
    assert held.lots == {(50,): (3.0, 2.0, 0.0, 0.0), (51,): (3.0, 2.0, 0.0, 0.0)}
    out = list(processor.handleInputRows(("a", "t"), iter([leg(102, False, 4.0), leg(103, False, None)]), None))
    assert held.lots == {(51,): (2.0, 2.0, 0.0, 2.0)} and out[1].balance == 2.0 and out[1].losses == out[0].losses
    balance, held = S._Balance(), _Held()
    balance.init(held)
    rows = [Row(order_no=2, leg=0, delta="-5"), Row(order_no=1, leg=1, delta="5")]
    assert [r.change for r in balance.handleInputRows(("t", "a"), iter(rows), None)] == [1, -1] and held.calls == 2


class _Slots(_Held):
    """A map state that counts its calls."""

    def exists(self):
        self.calls += 1
        return bool(self.lots)


def test_balances_of_a_slot_are_read_and_written_at_once():
    """A thousand addresses in one slot: one look for state and one writing, then a reading too; amounts of any size."""
    held, balances, scale = _Slots(), S._Balances(), 10 ** 30
    balances.init(held)

    def rows(*legs):
        return iter([pd.DataFrame([{"token": None if i % 2 else "t", "address": f"a{i}", "order_no": n, "unplaced": False, "leg": leg,
                                    "amount": str(i * size), "slot": 3, "part": 0} for i in range(1, 1001)]) for n, leg, size in legs])

    out = pd.concat(balances.handleInputRows((0,), rows((3, 1, 1), (2, 0, scale), (1, 1, scale)), None))
    assert held.calls == 2 and out.groupby("order_no")["change"].agg(["min", "max", "size"]).values.tolist() == [
        [1, 1, 1000], [-1, -1, 1000], [1, 1, 1000]]
    out = pd.concat(balances.handleInputRows((0,), rows((4, 0, 1)), None))
    assert held.calls == 5 and set(out["change"]) == {-1} and held.lots == {(3,): ("[]",)}


def test_balances_last_from_batch_to_batch(spark, folder):
    """Transfers without a place come last, amounts need more than 64 bits, an address sends to itself."""
    kind = "token string, from_address string, to_address string, amount decimal(38,0), order_no bigint"
    one, zero = 10 ** 37, S.ZERO_ADDRESS
    batches = [[("t", zero, "a", one, 2 ** 60 + 1), ("t", "a", "b", one, 2 ** 60 + 3), ("t", "b", "a", 3, None), (None, zero, "a", 5, 1)],
               [("t", "b", "a", one - 3, 2 ** 60 + 5), (None, "a", zero, 5, 2), ("t", "c", "c", 0, 3)]]
    for rows in batches:
        spark.createDataFrame([(t, s, d, Decimal(a), n) for t, s, d, a, n in rows], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = run(S.holder_changes_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")), folder, "changes")
    assert sorted((str(r.token), r.address, r.order_no or 0, r.change) for r in got.collect()) == sorted([
        ("t", "a", 2 ** 60 + 1, 1), ("t", "a", 2 ** 60 + 3, -1), ("t", "b", 2 ** 60 + 3, 1), ("t", "b", 0, 0), ("t", "a", 0, 1), ("None", "a", 1, 1),
        ("t", "b", 2 ** 60 + 5, -1), ("t", "a", 2 ** 60 + 5, 0), ("None", "a", 2, -1), ("t", "c", 3, 0), ("t", "c", 3, 0)])
