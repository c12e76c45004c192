"""Stateful operators with ``transformWithState``: positions, holders, first transfers.

State lives in the RocksDB state store, keyed by what may be worked on at the same time:
positions by (account, token), balances by hash groups of (token, address). The holder count of a
token is a second, small aggregate over the +1 / -1 changes. Rows of a key are sorted inside a
micro-batch, whose size the source bounds (``maxFilesPerTrigger`` and the like).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tradeweft.constants import ZERO_ADDRESS

# Processors travel to the workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Set on the session before a stateful query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Hash groups of addresses that are worked on at once, and the state values in which a group keeps its balances.
GROUPS, SLOTS = 1 << 12, 1 << 5


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def _place(row: Row) -> tuple:
    """Order of the rows of a key, those without a number last."""
    return row.order_no is None, row.order_no


def _number(value: Any) -> float:
    return float("nan") if value is None else float(value)


def _size(value: Any) -> float:
    return abs(_number(value))


class _Positions(StatefulProcessor):
    """Open lots and win / loss counts of one (account, token)."""

    EPS = 1e-10
    ZERO_PROFIT = 1e-12  # the batch operator's tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Lots are numbered; a sell reads and removes from the head, a buy adds at the
        # tail, so a long queue is never rewritten.
        self.lots = handle.getMapState("lots", "no BIGINT", "amount DOUBLE, price DOUBLE, pnl DOUBLE, spent DOUBLE")
        self.head = handle.getValueState("head", "first BIGINT, next BIGINT, balance DOUBLE, wins BIGINT, losses BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, nxt, balance, wins, losses = self.head.get() or (0, 0, 0.0, 0, 0)
        # A lot is read once and written once, and only if it outlives the batch.
        head, tail, lots, changed = first, nxt, {}, set()
        for row in sorted(rows, key=_place):
            amount, price, cost, profit = _size(row.amount), _number(row.price), 0.0, 0.0
            if amount > 0 and price > 0:
                if row.is_buy:
                    lots[nxt] = (amount, price, 0.0, 0.0)
                    changed.add(nxt)
                    nxt, balance = nxt + 1, balance + amount
                else:
                    left = amount
                    while left > self.EPS and first < nxt:
                        if first not in lots:
                            lots[first] = tuple(self.lots.getValue((first,)))
                        have, paid, pnl, spent = lots[first]
                        used = min(left, have)
                        cost += used * paid
                        profit += used * (price - paid)
                        pnl, spent = pnl + used * (price - paid), spent + used * paid
                        have, left = have - used, left - used
                        balance -= used
                        if have < self.EPS:
                            del lots[first]
                            changed.discard(first)
                            first += 1
                            won = pnl > spent * self.ZERO_PROFIT
                            wins, losses = wins + int(won), losses + int(not won)
                        else:
                            lots[first] = (have, paid, pnl, spent)
                            changed.add(first)
            yield Row(account=key[0], token=key[1], order_no=row.order_no, balance=balance, cost=cost, profit=profit,
                      wins=wins, losses=losses)
        for no in range(head, min(first, tail)):  # lots of earlier batches that are sold
            self.lots.removeKey((no,))
        for no in sorted(changed):
            self.lots.updateValue((no,), lots[no])
        self.head.update((first, nxt, balance, wins, losses))

    def close(self) -> None:
        pass


def positions_stream(legs: DataFrame) -> DataFrame:
    """Positions after each leg. ``legs``: account, token, order_no, is_buy, amount, price;
    ``order_no`` rises along the chain."""
    return legs.select("account", "token", "order_no", "is_buy", "amount", "price").groupBy("account", "token") \
        .transformWithState(
            _Positions(), "account STRING, token STRING, order_no BIGINT, balance DOUBLE, cost DOUBLE, "
            "profit DOUBLE, wins BIGINT, losses BIGINT", "Append", "none")


class _Balance(StatefulProcessor):
    """Balance of one (token, address), as text: amounts may be wider than any number type. What :class:`_Balances` does
    for a group at once, for streams that are keyed by address."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("balance", "v STRING")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Most keys have a few rows: plain rows and one reading of the state cost less than a frame each.
        held = self.value.get()
        balance = int(held[0]) if held else 0
        for row in sorted(rows, key=lambda r: (_place(r), r.leg)):
            before, balance = balance, balance + int(row.delta)
            change = -1 if before > 0 and balance == 0 else (1 if before == 0 and balance > 0 else 0)
            yield Row(token=key[0], address=key[1], order_no=row.order_no, change=change)
        self.value.update((str(balance),))

    def close(self) -> None:
        pass


class _Balances(StatefulProcessor):
    """Balances of one hash group of (token, address), packed into slots of the state: a batch reads and writes the
    slots it touches once each, whatever the number of addresses in them, and works on all rows of the group at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot INT", "balances STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        token, address = (pd.factorize(pdf[c], use_na_sentinel=False)[0].astype("int64") for c in ("token", "address"))
        who = token * (address.max() + 1) + address
        place = np.lexsort((pdf["leg"], pdf["order_no"], pdf["unplaced"], who))
        pdf, who = pdf.iloc[place], who[place]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1])
        ends = np.append(begins[1:], len(who)) - 1
        of = np.repeat(np.arange(len(begins)), ends - begins + 1)

        firsts = pdf.iloc[begins]
        names = list(zip(firsts["slot"].tolist(), firsts["token"].tolist(), firsts["address"].tolist()))
        known, held = self.slots.exists(), {}
        for slot in sorted({n[0] for n in names}):
            found = self.slots.getValue((slot,)) if known else None
            held[slot] = {(t, a): b for t, a, b in json.loads(found[0])} if found else {}
        opening = [held[slot].get((t, a), 0) for slot, t, a in names]

        leg, amounts = pdf["leg"].to_numpy(), [int(v) for v in pdf["amount"]]
        most = max(map(abs, amounts)) * len(amounts) + max(map(abs, opening))
        kind = "int64" if most < 1 << 62 else object
        own = np.array(amounts, dtype=kind)
        own = np.where(leg == 0, -own, own)
        total = np.cumsum(own)
        after = total - (total[begins] - own[begins] - np.array(opening, dtype=kind))[of]
        before = after - own
        change = np.where((before > 0) & (after == 0), -1, np.where((before == 0) & (after > 0), 1, 0)).astype("int32")

        for (slot, t, a), balance in zip(names, after[ends].tolist()):
            if balance:
                held[slot][t, a] = balance
            else:  # as good as an address that was never seen
                held[slot].pop((t, a), None)
        for slot, balances in held.items():
            self.slots.updateValue((slot,), (json.dumps([[t, a, b] for (t, a), b in balances.items()]),))
        yield pdf[["token", "address", "order_no", "unplaced"]].assign(change=change)

    def close(self) -> None:
        pass


def holder_changes_stream(transfers: DataFrame) -> DataFrame:
    """+1 / -1 per (token, address, transfer) of a stream without overdrawing transfers.
    ``transfers``: token, from_address, to_address, amount, order_no."""
    amount = F.col("amount").cast("decimal(38,0)")
    legs = F.array(F.struct(F.col("from_address").alias("address"), F.lit(0).alias("leg")),
                   F.struct(F.col("to_address").alias("address"), F.lit(1).alias("leg")))
    rows = transfers.select("token", "order_no", amount.alias("amount"), F.explode(legs).alias("_x")) \
        .select("token", "order_no", "amount", "_x.*").filter(F.col("address") != ZERO_ADDRESS)
    number = F.xxhash64("token", "address")
    packed = rows.select(
        "token", "address", F.coalesce(F.col("order_no").cast("long"), F.lit(0)).alias("order_no"), F.col("order_no").isNull().alias("unplaced"),
        "leg", F.col("amount").cast("string").alias("amount"), F.pmod(number, F.lit(GROUPS)).cast("int").alias("part"),
        F.pmod(F.shiftright(number, GROUPS.bit_length() - 1), F.lit(SLOTS)).cast("int").alias("slot"))
    changes = packed.groupBy("part").transformWithStateInPandas(
        _Balances(), "token STRING, address STRING, order_no BIGINT, unplaced BOOLEAN, change INT", "Append", "none")
    return changes.select("token", "address", F.when(~F.col("unplaced"), F.col("order_no")).alias("order_no"), "change")


class _First(StatefulProcessor):
    """Remembers that a token has been seen; emits its first transfer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "order_no BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:  # only the smallest row is kept, whatever the size of the group
            row = pdf.loc[[pdf["order_no"].idxmin()]]
            if best is None or row["order_no"].iloc[0] < best["order_no"].iloc[0]:
                best = row
        if best is not None and not self.seen.exists():
            self.seen.update((int(best["order_no"].iloc[0]),))
            yield best[["token", "from_address", "to_address", "order_no"]]

    def close(self) -> None:
        pass


def first_transfers_stream(transfers: DataFrame) -> DataFrame:
    return transfers.select("token", "from_address", "to_address", "order_no").groupBy("token") \
        .transformWithStateInPandas(_First(), "token STRING, from_address STRING, to_address STRING, order_no BIGINT",
                                    "Append", "none")


def holder_snapshots_stream(counts: DataFrame, interval: str = "5 minutes", lateness: str = "0 seconds") -> DataFrame:
    """Last holder count per token and closed bucket (append mode).

    ``counts``: timestamp, token, holders, order_no."""
    out = counts.withWatermark("timestamp", lateness).groupBy(
        "token", F.window("timestamp", interval).alias("_w")).agg(F.max_by("holders", "order_no").alias("holders"))
    return out.select("token", F.col("_w.start").alias("bucket_ts"), "holders")
