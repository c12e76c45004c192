"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt to shards of about ``SHARD`` by a hash of their row; the number of shards grows
with the input. Each shard is solved by ``ISLANDS`` islands, each with a population of packings. A
child takes whole well-filled sequences of one parent, drops the sequences of the other that hold
a piece twice, and places the displaced pieces by best fit, longest first. Between epochs each
island's best packing migrates to the next island of the shard. After a round, sequences that are
full to ``GOOD`` stay; the pieces of the others are pooled over all shards and packed again; the
last round keeps everything.

Defined results: a null or empty text is its end token alone; a text of just the capacity is one
piece; longer ones have a first piece of the remainder and then full pieces; rows without doc_id
take no part; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft.llm.tokens import GROUP, HELD, encoder
from tradeweft.session import written_table

CAPACITY = 1024
#: Documents encoded before their pieces leave the worker.
SLICE = 500
SHARD, ISLANDS, POPULATION = 8192, 2, 4
EPOCHS, GENERATIONS, ROUNDS = 2, 8, 3
GOOD = 0.995


def pieces(documents: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, held: int = HELD,
           group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of every piece of every document.

    ``held`` and ``group`` bound the memory of a worker, see :func:`tradeweft.llm.tokens.encoder`.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(path, held, group), np.array([end], "<u4").tobytes()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist())):
                ids += last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc_id, k, a, b - a, ids[4 * a:4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5,
                                                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "piece", "start", "length", "ids"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, schema)


class Packing:
    """Bin of each item, and the load of each bin."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray):
        self.bins = bins
        self.loads = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.zeros(0, np.int64)

    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.loads), float(np.dot(self.loads, self.loads))


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Place ``items`` in this order where least room stays; ``bins`` and ``loads`` change in place."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, load in enumerate(loads):
        rooms[capacity - load].append(b)
    mask = sum(1 << r for r, some in enumerate(rooms) if some)
    for i, n in zip(items.tolist(), lengths[items].tolist()):
        fits = mask >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        loads[b] += n
        rooms[room - n].append(b)
        mask |= 1 << (room - n)
        bins[i] = b


def fresh(lengths: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> Packing:
    """Best fit by decreasing length, the lengths blurred by ``noise``."""
    bins = np.zeros(len(lengths), np.int32)
    order = np.argsort(-(lengths + rng.random(len(lengths)) * noise), kind="stable")
    best_fit(lengths, order, bins, [], capacity)
    return Packing(bins, lengths)


def cross(one: Packing, two: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``two`` go into ``one``."""
    order = np.argsort(-two.loads, kind="stable")[:max(1, len(two.loads) // 2)]
    taken = rng.choice(order, max(1, len(order) // 8), replace=False)
    given = np.zeros(len(two.loads), bool)
    given[taken] = True
    injected = given[two.bins]
    broken = np.zeros(len(one.loads), bool)
    broken[one.bins[injected]] = True
    weak = np.argsort(one.loads, kind="stable")[:1 + len(one.loads) // 50]
    broken[weak] = True
    displaced = np.flatnonzero(broken[one.bins] & ~injected)
    bins = (np.cumsum(~broken) - 1)[one.bins].astype(np.int32)
    kept = int((~broken).sum())
    bins[injected] = kept + (np.cumsum(given) - 1)[two.bins[injected]]
    loads = [*one.loads[~broken].tolist(), *two.loads[given].tolist()]
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], bins, loads, capacity)
    return Packing(bins, lengths)


def evolve(lengths: np.ndarray, bins: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    """One epoch of an island, best packing first. An empty population is set up."""
    rng = np.random.default_rng(seed)
    own = [Packing(b, lengths) for b in bins]
    while len(own) < POPULATION:
        own.append(fresh(lengths, capacity, 64.0 * len(own), rng))
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(GENERATIONS):
        own.sort(key=Packing.worth, reverse=True)
        if len(own[0].loads) <= least:
            break
        a, b = rng.choice(len(own), 2, replace=False)
        own = own[:POPULATION - 2] + [cross(own[0], own[max(a, b)], lengths, capacity, rng),
                                      cross(own[a], own[b], lengths, capacity, rng)]
    return [p.bins for p in sorted(own, key=Packing.worth, reverse=True)]


def _epoch(states: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch of every island. ``states`` has a row for each island of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                lengths = np.array(row["lengths"], np.int64)
                held = [np.frombuffer(b, np.int32) for b in [*(row["packings"] or []), row["guest"]] if b is not None]
                if len(held) > POPULATION:
                    held = held[:POPULATION - 1] + held[-1:]
                out = evolve(lengths, held, capacity, hash((seed, row["shard"], row["island"])) & 0x7FFFFFFF)
                made = Packing(out[0], lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                     batch.column("rows").slice(k, 1), batch.column("lengths").slice(k, 1),
                     pa.array([[b.tobytes() for b in out]], pa.list_(pa.binary())),
                     pa.array([len(made.loads)], pa.int64()), pa.array([made.worth()[1]], pa.float64())],
                    ["shard", "island", "rows", "lengths", "packings", "used", "fill"])

    return states.mapInArrow(run, "shard long, island int, rows array<long>, lengths array<int>, "
                                  "packings array<binary>, used long, fill double")


def _placed(best: DataFrame) -> DataFrame:
    """row, shard, bin, offset and the load of the bin, from the best packing of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = np.array(row["lengths"], np.int64), np.frombuffer(row["packing"], np.int32)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                loads = np.bincount(bins, weights=lengths).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(loads)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(row["rows"], np.int64)[order]), pa.array(np.full(len(bins), row["shard"], np.int64)),
                     pa.array(bins[order].astype(np.int64)), pa.array(ends - lengths[order] - first[bins[order]]),
                     pa.array(loads[bins[order]]), pa.array(lengths[order].astype(np.int32))],
                    ["row", "shard", "bin", "offset", "load", "length"])

    return best.mapInArrow(run, "row long, shard long, bin long, offset long, load long, length int")


def _round(items: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Placement of the items (row, length) by islands; written."""
    shards = max(1, -(-items.count() // SHARD))
    own = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards))
    states = (items.groupBy(own.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("m"))
              .select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                      F.col("m.row").alias("rows"), F.col("m.length").alias("lengths"),
                      F.lit(None).cast("array<binary>").alias("packings"), F.lit(None).cast("binary").alias("guest")))
    states = states.repartition("shard", "island")
    for epoch in range(EPOCHS):
        done = written_table(_epoch(states, capacity, 100 * turn + epoch), "islands")
        elite = done.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                            F.element_at("packings", 1).alias("guest"))
        states = done.drop("used", "fill").join(elite, ["shard", "island"])
    best = done.groupBy("shard").agg(F.min_by(F.struct("rows", "lengths", F.element_at("packings", 1).alias("packing")),
                                              F.struct("used", -F.col("fill"), "island")).alias("b"))
    return written_table(_placed(best.select("shard", "b.*")), "placed")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (any columns, with length from 1 to ``capacity``) with sequence_id and offset."""
    made = written_table(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = made.where(F.col("length") == capacity).select(
        "row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, found = made.where(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("length")), [whole]
    for turn in range(ROUNDS):
        placed = _round(items, capacity, turn)
        kept = placed if turn == ROUNDS - 1 else placed.where(F.col("load") >= int(GOOD * capacity))
        number = F.lit(turn << 58) + F.shiftleft("shard", 24) + F.col("bin")
        found.append(kept.select("row", number.alias("sequence_id"), "offset"))
        items = placed.where(F.col("load") < int(GOOD * capacity)).select("row", "length")
    places = found[0]
    for more in found[1:]:
        places = places.union(more)
    return made.join(places, "row").drop("row")


def pack_documents(documents: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, held: int = HELD,
                   group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = pieces(documents, path, end, capacity, held, group).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(made, capacity)


def sequences(documents: DataFrame, packed: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and the ids of each sequence; each group holds ``capacity`` ids at most."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    made = pieces(documents, path, end, capacity).withColumn("ids_crc32", F.crc32("ids")).dropDuplicates(keys)
    parts = packed.join(made, keys)
    ordered = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["ids"]), "")).alias("ids"))
