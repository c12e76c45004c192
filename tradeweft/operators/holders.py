"""Holder counts from transfers and from token balances.

Fast path: running balance per (token, address), +1 / -1 where it leaves or reaches zero,
running sum per token. It is exact for every token in which no transfer overdraws its
sender. An overdrawing transfer is rejected whole, which changes later balances; such
tokens are replayed first, and the same pass counts the rest. Amounts may have 256 bits: the
rows of usual keys are walked in sorted batches with integers of any size, those of large keys
are summed as limbs (:mod:`tradeweft.functions.wide`) in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeweft.constants import ZERO_ADDRESS
from tradeweft.functions import wide as W
from tradeweft.functions.keys import CHAIN_ORDER
from tradeweft.functions.time import bucket
from tradeweft.operators.ordered import CHUNK, POS, Scan, by_size, chunk, cumulative, scan
from tradeweft.session import written_table

_AMOUNT, _LIMB = "decimal(38,0)", "decimal(27,0)"


def first_transfers(transfers: DataFrame, order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """First transfer of each token."""
    rest = [c for c in transfers.columns if c != "token"]
    return transfers.groupBy("token").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_t")) \
        .select("token", "_t.*")


def _tracked(transfers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Transfers of tokens whose first transfer is a mint."""
    first = transfers.groupBy("token").agg(F.min_by("from_address", F.struct(*order)).alias("_from"))
    # written, so that every pass sees how few they are and need not shuffle the transfers by token
    tokens = written_table(first.filter(F.col("_from") == ZERO_ADDRESS).select("token"), "tokens")
    return transfers.join(tokens, "token", "left_semi")


def _units(transfers: DataFrame, amount: str) -> tuple[Column, int]:
    """The amount as DECIMAL(38,0) or decimal text, and the number of its limbs."""
    kind, value = transfers.schema[amount].dataType, F.col(amount)
    count = W.limb_count(kind)
    if count < 3:
        return value.cast(_AMOUNT), count
    text = W.digits(W.limbs(value, count))
    return (F.when(value.rlike("^[+-]?[0-9]{1,81}$"), value).otherwise(text) if isinstance(kind, T.StringType) else text), count


def _legs(transfers: DataFrame, order: Sequence[str], amount: str) -> tuple[DataFrame, int]:
    """Debit (``leg`` 0, with its receiver as ``other``) then credit of each transfer, without the zero address, and the limbs of ``units``."""
    units, count = _units(transfers, amount)
    nobody = F.lit(None).cast("string")
    legs = F.array(F.struct(F.col("from_address").alias("address"), F.col("to_address").alias("other"), F.lit(0).alias("leg")),
                   F.struct(F.col("to_address").alias("address"), nobody.alias("other"), F.lit(1).alias("leg")))
    return transfers.select("token", *order, units.alias("units"), F.explode(legs).alias("_x")) \
        .select("token", *order, "_x.*", "units").filter(F.col("address") != ZERO_ADDRESS), count


def _deltas(legs: DataFrame, count: int, order: Sequence[str], replay: Callable | None = None) -> DataFrame:
    """Legs with ``change`` and ``overdrawn``, from the running balance of their address.

    With ``replay``, of usual addresses that would overdraw only the debits come back that a replay rejects, with
    ``replayed``; the legs of the others come without ``address`` and ``other``.
    """
    who, sort = ["token", "address"], ["token", "address", *order, "leg"]
    rest = [*sort[:2], *([] if replay is None else ["other"]), *sort[2:]]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in legs.select(*rest).schema), T.StructField("change", T.IntegerType()),
                           T.StructField("overdrawn", T.BooleanType()), T.StructField("replayed", T.BooleanType())])
    found = []
    for part in by_size(legs.select(*rest, "units"), who, sort[2:]):
        if part.whole:
            # sorted by a number first: most comparisons end there, and keys only have to lie together
            rows = part.df.drop(POS).withColumn("_key", F.xxhash64(*who)).sortWithinPartitions("_key", *sort).drop("_key")
            found.append(rows.mapInArrow(_walk(rest, count, replay), schema))
            continue
        own = [F.when(F.col("leg") == 0, -p).otherwise(p).cast(_LIMB) for p in W.limbs(F.col("units"), count)]
        part = part.map(part.df.withColumns({f"d{i}": p for i, p in enumerate(own)}))
        rows = scan(part, *[Scan(f"b{i}", "sum", F.col(f"d{i}")) for i in range(count)]).rows()
        after = W.sign([F.col(f"b{i}") for i in range(count)])
        before = W.sign([F.col(f"b{i}") - F.col(f"d{i}") for i in range(count)])
        signs = rows.withColumns({"_after": after, "_before": before})
        change = F.when((F.col("_before") > 0) & (F.col("_after") == 0) & (F.col("leg") == 0), -1) \
            .when((F.col("_before") == 0) & (F.col("_after") > 0) & (F.col("leg") == 1), 1).otherwise(0)
        found.append(signs.select(*rest, change.alias("change"), ((F.col("leg") == 0) & (F.col("_after") < 0)).alias("overdrawn"),
                                  F.lit(False).alias("replayed")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _integers(units: pa.Array, leg: np.ndarray) -> np.ndarray:
    """Signed amounts as 64-bit integers whose sums fit, else as integers of any size; nothing where they are null."""
    none = units.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(units.type):
        words = np.frombuffer(units.buffers()[1], "<i8")[2 * units.offset:2 * (units.offset + len(units))].reshape(-1, 2)
        low, high = words[:, 0], words[:, 1]
        if not ((high != low >> 63) & ~none).any():
            values = np.where(none, 0, low)
            if not len(values) or max(abs(int(values.min())), abs(int(values.max()))) * len(values) < 1 << 62:
                return np.where(leg == 0, -values, values)
        whole = [0 if n else (h << 64) | (v & (1 << 64) - 1) for v, h, n in zip(low.tolist(), high.tolist(), none.tolist())]
    else:
        whole = [0 if v is None else int(v) for v in units.to_pylist()]
    values = np.empty(len(whole), dtype=object)
    values[:] = [-v if s == 0 else v for v, s in zip(whole, leg.tolist())]
    return values


def _begins(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Places after the first row where a column differs from the row before."""
    differs = np.zeros(max(0, len(batch) - 1), dtype=bool)
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        differs |= codes[1:] != codes[:-1]
    return np.flatnonzero(differs) + 1


def _walk(columns: Sequence[str], count: int, replay: Callable | None):
    """Streams the sorted legs of whole keys: the rows with ``change``, ``overdrawn`` and ``replayed``."""
    who = ["token", "address"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the key that the last batch ended with
        for batch in batches:
            if not len(batch):
                continue
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in who):
                yield from walked(held)
                held = []
            begins = _begins(batch, who)
            if len(begins):
                yield from walked([*held, batch.slice(0, begins[-1])])
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield from walked(held)

    def walked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        begins = np.concatenate([[0], _begins(rows, who)])
        key = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
        leg = rows.column("leg").to_numpy()
        own = _integers(rows.column("units"), leg)
        total = np.cumsum(own)
        after = total - (total[begins] - own[begins])[key]
        before = after - own
        change = np.where((before > 0) & (after == 0) & (leg == 0), -1, np.where((before == 0) & (after > 0) & (leg == 1), 1, 0))
        none = rows.column("units").is_null().to_numpy(zero_copy_only=False)
        if none.any():  # as in the sums of limbs: no balance before an unknown amount, unless there is one limb
            change = np.where(none, (leg == 1) & (after > 0) if count > 1 else 0, change)
        over = ((leg == 0) & (after < 0)).astype(bool)
        if replay is not None and over.any():
            poor = np.zeros(len(begins), dtype=bool)
            poor[key[over]] = True
            poor = poor[key]
            for lost in replay(iter([rows.filter(pa.array(poor))])):
                yield built(lost, np.zeros(len(lost)), np.ones(len(lost), dtype=bool), True)
            rows, change, over = rows.filter(pa.array(~poor)), change[~poor], over[~poor]
        if replay is not None:
            for c in ("address", "other"):
                rows = rows.set_column(rows.schema.get_field_index(c), c, pa.nulls(len(rows), rows.schema.field(c).type))
        yield built(rows, change, over, False)

    def built(rows: pa.RecordBatch, change: np.ndarray, over: np.ndarray, replayed: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*rows.select(columns).columns, pa.array(change.astype("int32")), pa.array(over), pa.array(np.full(len(rows), replayed))],
            [*columns, "change", "overdrawn", "replayed"])

    return run


def holder_deltas(transfers: DataFrame, order: Sequence[str] = CHAIN_ORDER, amount: str = "amount") -> DataFrame:
    """Change of the holder count by each leg: -1 when a balance reaches zero, +1 when one
    leaves zero. ``amount`` may be a number or decimal text of up to 256 bits."""
    return _deltas(*_legs(transfers, order, amount), order).drop("overdrawn", "replayed")


def overdrawn_tokens(transfers: DataFrame, order: Sequence[str] = CHAIN_ORDER, amount: str = "amount") -> DataFrame:
    return _deltas(*_legs(transfers, order, amount), order).filter("overdrawn").select("token").distinct()


def rejected_transfers(transfers: DataFrame, order: Sequence[str] = CHAIN_ORDER, amount: str = "amount") -> DataFrame:
    """Keys of the transfers that a sequential replay rejects because they overdraw.

    Legs are range-partitioned by token, address and order, and every chunk is replayed at once:
    debits against a balance that starts from what the chunk before is believed to hand on, credits
    as far as the last round accepted them. A chunk reports, for the addresses that cross its borders,
    what they entered with, the least of their running total, what they leave with and whether
    anything was rejected: an address with no rejection and a least total that the new balance still
    covers only shifts by the difference. Addresses whose balance changed otherwise, or that send and
    were sent a transfer whose rejection changed, go round again, until none is left. The fixed point is
    the sequential result, since a decision depends on earlier ones only; each round settles at least
    the earliest open one.
    """
    legs = written_table(_legs(transfers, order, amount)[0], "legs")
    return _settled(legs, order, legs.filter("leg = 0").select("token", "address").distinct())


def _settled(legs: DataFrame, order: Sequence[str], again: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """``again``: token and address of all that could overdraw if every credit were accepted, or but for those of the
    transfers that are ``rejected`` so far, with their senders."""
    spark, key, who = legs.sparkSession, ["token", *order], ["token", "address"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = chunk(legs.select(*key, "address", "leg", "units"), who, [*order, "leg"], max(2, parts))
    border = {tuple(r) for r in placed.border.collect()} if placed.border is not None else set()  # two per chunk
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in legs.select(*key).schema),
                           *(T.StructField(n, k) for n, k in _EDGE)])
    carries, edges = {}, {}
    while True:
        rows = placed.df.join(again, who, "left_semi")
        if rejected is not None:
            # a rejected credit stays as nothing, so that every border address reports from each of its chunks
            no = rejected.select(*key).distinct().withColumn("_no", F.lit(True))
            rows = rows.join(no, key, "left").withColumn(
                "units", F.when((F.col("leg") == 1) & F.col("_no"), F.lit("0").cast(legs.schema["units"].dataType))
                .otherwise(F.col("units"))).drop("_no")
        rows = rows.repartition(parts, CHUNK).sortWithinPartitions(CHUNK, POS)
        round_ = written_table(rows.mapInArrow(_replay(key, border, carries), schema), "replay")
        found = round_.filter("part IS NULL").select(*key, "address")
        for e in round_.filter("part IS NOT NULL").collect():  # two per chunk at most
            edges[e.token, e.address, e.part] = [int(e.entered), int(e.least), int(e.left), e.bad]
        carries, moved = _handed_on(edges)
        changed, after = found.select(*key), found
        if rejected is not None:
            sides = rejected.join(again, who, "left_semi").select(*key, F.lit(1).alias("_was"), F.lit(0).alias("_is")) \
                .unionByName(found.select(*key, F.lit(0).alias("_was"), F.lit(1).alias("_is")))
            changed = sides.groupBy(*key).agg(F.max("_was").alias("_was"), F.max("_is").alias("_is")) \
                .filter("_was <> _is").select(*key)
            after = written_table(rejected.join(again, who, "left_anti").unionByName(found), "rejected")
        open_ = placed.df.filter("leg = 1").join(changed, key, "left_semi").select(*who).distinct() \
            .join(placed.df.filter("leg = 0").select(*who), who, "left_semi")
        if moved:
            open_ = open_.unionByName(spark.createDataFrame(sorted(moved), open_.schema)).distinct()
        rejected, again = after, written_table(open_, "again")
        if again.isEmpty():
            return rejected.select(*key)


#: What a chunk says of an address that crosses its border.
_EDGE = (("address", T.StringType()), ("part", T.IntegerType()), ("entered", T.StringType()), ("least", T.StringType()),
         ("left", T.StringType()), ("bad", T.BooleanType()))


def _handed_on(edges: dict) -> tuple[dict, set]:
    """Balances that border addresses enter their chunks with, and addresses of which a chunk has to be replayed."""
    carries, moved, last, held = {}, set(), None, 0
    for token, address, part in sorted(edges):
        if (token, address) != last:
            last, held = (token, address), 0
        edge = edges[token, address, part]
        entered, least, left, bad = edge
        if entered != held:
            if bad or held + least < 0:
                moved.add((token, address))
            else:
                edge[0], edge[2] = held, left + held - entered
            left += held - entered
        carries[token, address, part] = held
        held = left
    return carries, moved


def _replay(key: list[str], border: set, carries: dict):
    """Streams the sorted legs of its chunks: keys and senders of rejected transfers, and edges (with null order columns)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, balance, entered, total, least, any_bad = None, 0, 0, 0, 0, False
        kinds = {"part": pa.int32(), "bad": pa.bool_()}

        def report() -> list[dict]:
            if who is None or who[:2] not in border:
                return []
            token, address, part = who
            return [{"token": token, "address": address, "part": part, "entered": str(entered), "least": str(least),
                     "left": str(balance), "bad": any_bad}]

        fields = None
        for batch in batches:
            if fields is None:
                fields = [batch.schema.field(k).with_nullable(True) for k in key]
                schema = pa.schema([*fields, *(pa.field(n, kinds.get(n, pa.string())) for n, _ in _EDGE)])
            bad, reports, names = [], [], ("token", "address", CHUNK)
            own = _integers(batch.column("units"), batch.column("leg").to_numpy()).tolist()
            begins = [0, *_begins(batch, names).tolist()] if own else []
            firsts = batch.take(pa.array(begins, pa.int64()))
            for now, lo, hi in zip(zip(*(firsts.column(c).to_pylist() for c in names)), begins, [*begins[1:], len(own)]):
                if now != who:
                    reports += report()
                    who = now
                    balance = entered = carries.get(who, 0)
                    total, least, any_bad = 0, 0, False
                for i in range(lo, hi):
                    delta = own[i]
                    if balance + delta >= 0:
                        balance, total = balance + delta, total + delta
                        if total < least:
                            least = total
                    else:
                        any_bad = True
                        bad.append(i)
            lost = batch.select([*key, "address"]).take(pa.array(bad, pa.int64()))
            empty = [pa.nulls(len(lost), f.type) for f in list(schema)[len(key) + 1:]]
            yield pa.RecordBatch.from_arrays([*lost.columns, *empty], schema=schema)
            if reports:
                yield pa.RecordBatch.from_pylist(reports, schema)
        if last := report():
            yield pa.RecordBatch.from_pylist(last, schema)
    return run


def holder_counts(transfers: DataFrame, strict: bool = True, order: Sequence[str] = CHAIN_ORDER, compat: bool = False,
                  amount: str = "amount") -> DataFrame:
    """Holder count of a token after each of its accepted transfers.

    ``strict`` looks for overdrawing transfers and leaves the rejected ones out; without
    it the input is taken as clean. ``compat``: a burn that empties a holder does not lower
    the stored count (the count moves on only with transfers to a real address). ``amount``
    is a number or decimal text of up to 256 bits.
    """
    key = ["token", *order]
    # several passes read them, so they are worked out once
    moves = written_table(transfers.select(*key, "from_address", "to_address", F.col(amount).alias("_amount")), "transfers")
    rows = _tracked(moves, order)
    legs, count = _legs(rows, order, "_amount")
    rejected = None
    if not strict:
        deltas = _deltas(legs, count, order).select(*key, "change")
    else:
        columns = [c for c in legs.columns if c not in ("address", "units")]
        first = written_table(_deltas(legs, count, order, _replay(columns, set(), {})), "deltas")
        overdrawn, deltas = first.filter("overdrawn"), first.select(*key, "change")
        if not overdrawn.isEmpty():
            tokens = written_table(overdrawn.select("token").distinct(), "tokens")
            rejected = _rejected(rows, legs, overdrawn, tokens, order)
            kept = written_table(rows.join(tokens, "token", "left_semi").join(rejected, key, "left_anti"), "accepted")
            deltas = deltas.join(tokens, "token", "left_anti").unionByName(
                _deltas(*_legs(kept, order, "_amount"), order).select(*key, "change"))
    deltas = deltas.groupBy(*key).agg(F.sum("change").alias("change"))
    # A transfer from the zero address to itself has no leg, but it is a transfer.
    idle = rows.filter((F.col("from_address") == ZERO_ADDRESS) & (F.col("to_address") == ZERO_ADDRESS))
    deltas = deltas.unionByName(idle.select(*key, F.lit(0).cast("long").alias("change")))
    if compat:
        burns = rows.filter(F.col("to_address") == ZERO_ADDRESS).select(*key)
        if rejected is not None:
            burns = burns.join(rejected, key, "left_anti")
        deltas = deltas.join(burns, key, "left_anti").unionByName(burns.withColumn("change", F.lit(0).cast("long")))
    return cumulative(deltas, "change", ["token"], list(order), "holders").drop("change")


def _rejected(rows: DataFrame, legs: DataFrame, overdrawn: DataFrame, tokens: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keys of the transfers that are rejected in the end, from the overdrawn debits of the first pass."""
    key, who = ["token", *order], ["token", "address"]
    found = overdrawn.filter("replayed").select(*key, "address")
    senders = rows.select("token", F.col("from_address").alias("address")).distinct()
    again = overdrawn.filter("replayed").select("token", F.col("other").alias("address")).distinct() \
        .join(senders, who, "left_semi").unionByName(overdrawn.filter("NOT replayed").select(*who)).distinct()
    again = written_table(again, "again")
    if again.isEmpty():
        return found.select(*key)
    return _settled(legs.join(tokens, "token", "left_semi"), order, again, found)


def holder_snapshots(counts: DataFrame, interval: str = "5 minutes", closed_only: bool = True,
                     order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """Last count per (token, bucket) in which the token moved. ``closed_only``: a bucket
    is out only once a later one has begun."""
    snap = counts.withColumn("_b", bucket(F.col("timestamp"), interval)).groupBy("token", "_b").agg(
        F.max_by("holders", F.struct(*order)).alias("holders")).withColumnRenamed("_b", "bucket_ts")
    if closed_only:
        snap = written_table(snap, "snapshots")  # its last bucket is that of the last count
        last = snap.agg(F.max("bucket_ts").alias("_open"))
        snap = snap.join(F.broadcast(last), F.col("bucket_ts") < F.col("_open")).drop("_open")
    return snap


def latest_holders(snapshots: DataFrame, ts: str = "bucket_ts") -> DataFrame:
    return snapshots.groupBy("token").agg(F.max_by("holders", ts).alias("holders"))


def holder_counts_balances(balances: DataFrame, inits: DataFrame) -> DataFrame:
    """Holder count per (token, block) from token balances before and after transactions.

    ``balances``: block_number, pre_mint, post_mint, pre_amount, post_amount. ``inits``:
    token, block_number. Only tokens created in range count, from their block on.
    """
    pre, post = F.coalesce(F.col("pre_amount"), F.lit(0)), F.coalesce(F.col("post_amount"), F.lit(0))
    change = F.when((pre == 0) & (post != 0), 1).when((pre != 0) & (post == 0), -1)
    per_block = balances.select(F.coalesce("post_mint", "pre_mint").alias("token"), "block_number",
                                change.alias("change")).filter(F.col("change").isNotNull()) \
        .groupBy("token", "block_number").agg(F.sum("change").alias("change"))
    born = inits.groupBy("token").agg(F.min("block_number").alias("_born"))
    rows = per_block.join(born, "token").filter(F.col("block_number") >= F.col("_born")) \
        .select("token", "block_number", "change") \
        .unionByName(born.select("token", F.col("_born").alias("block_number"), F.lit(0).cast("long").alias("change")))
    rows = rows.groupBy("token", "block_number").agg(F.sum("change").alias("change"))
    return cumulative(rows, "change", ["token"], ["block_number"], "holders").drop("change")


def balance_history(transfers: DataFrame, address: str, token: str,
                    order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """Balance of one address in one token after each of its transfers."""
    mine = transfers.filter((F.col("token") == token) & ((F.col("from_address") == address)
                                                         | (F.col("to_address") == address)))
    amount: Column = F.col("amount") * F.col("sign")
    delta = F.when(F.col("to_address") == address, amount).otherwise(F.lit(0)) \
        - F.when(F.col("from_address") == address, amount).otherwise(F.lit(0))
    return cumulative(mine.select(*order, delta.cast(_AMOUNT).alias("_d")), "_d", [], list(order),
                      "balance").drop("_d")


def after_checkpoint(df: DataFrame, last: tuple, order: Sequence[str] = CHAIN_ORDER) -> DataFrame:
    """Rows strictly after the last processed order key."""
    values = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last)])
    return df.filter(F.struct(*order) > values)
