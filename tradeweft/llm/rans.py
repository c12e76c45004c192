"""Token ids in files: static range asymmetric numeral systems with interleaved lanes.

Documents are put in order of id, tokenised, and gathered into segments of about ``SEGMENT`` ids. A
segment is one record of the file table: the frequency table that all its blocks share, the ids
and sizes of its documents, and blocks of ``LANES`` x ``STEPS`` ids. A block is coded by itself,
with ``LANES`` interleaved states (64 bits, renormalised by 32-bit words); it carries a checksum and
checkpoints (the states and the place in its words every ``CHECKPOINT`` steps), so that blocks, and
parts of blocks, can be decoded in parallel.

Defined results: a null or empty text is its end id alone; rows without doc_id take no part; repeated
rows with one doc_id are written as often as they occur, in order of the hash of their texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeweft.llm.tokens import encoder
from tradeweft.session import scratch_dir

LANES, STEPS, CHECKPOINT, SEGMENT = 1024, 256, 128, 1 << 21
#: Bytes that the encoder of a worker remembers of words and of word pieces, each: nothing else here is large.
HELD = 256 << 20
#: Frequencies add up to 2 ** SCALE.
SCALE = 20
#: Ids below this are counted and numbered by arrays, others by sorting and searching.
_COUNTED = 1 << 22
_LOW = np.uint64(1 << 31)
_MAGIC = b"rANS-seg1"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in order and their frequencies, each at least 1, with the sum 2 ** SCALE."""
    counts = np.bincount(ids) if len(ids) and int(ids.max()) < _COUNTED else None
    symbols, counts = np.unique(ids, return_counts=True) if counts is None else (np.flatnonzero(counts), counts[counts > 0])
    freq = np.maximum(1, counts * (1 << SCALE) // max(len(ids), 1))
    rest = (1 << SCALE) - int(freq.sum())
    while rest:
        top = int(freq.argmax())
        step = rest if rest > 0 else -min(-rest, int(freq[top]) // 2)
        freq[top] += step
        rest -= step
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(symbols)), freq)


def encode_block(places: np.ndarray, table: Table) -> bytes:
    """Code symbol numbers: count, checkpoints, words, all under a checksum."""
    n, scale = len(places), np.uint64(SCALE)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    words, marks, sent = [], [], 0
    for t in range(steps - 1, -1, -1):
        own = places[t * LANES:(t + 1) * LANES]
        f, x = table.freq[own], state[:len(own)]
        over = x >= (f << np.uint64(63 - SCALE))
        out = x[over]
        words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        sent += len(out)
        x[over] = out >> np.uint64(32)
        q = x // f
        x[:] = (q << scale) + (x - q * f) + table.first[own]
        if t % CHECKPOINT == 0:
            marks.append((t, sent, state.copy()))
    body = b"".join(struct.pack("<II", t, sent - at) + x.astype("<u8").tobytes() for t, at, x in marks[::-1])
    body = struct.pack("<III", n, len(marks), sent) + body + b"".join(w.tobytes() for w in words[::-1])
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_block(data: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """Symbol numbers of a block, or of the part from one checkpoint to the next."""
    if zlib.crc32(data[4:]) != struct.unpack_from("<I", data)[0]:
        raise ValueError("checksum of a block does not match")
    n, marks, _ = struct.unpack_from("<III", data, 4)
    size = 8 + 8 * LANES
    words = np.frombuffer(data, "<u4", offset=16 + marks * size).astype(np.uint64)
    t, at = struct.unpack_from("<II", data, 16 + (part or 0) * size)
    state = np.frombuffer(data, "<u8", LANES, 16 + (part or 0) * size + 8).astype(np.uint64)
    stop = -(-n // LANES) if part is None else min(t + CHECKPOINT, -(-n // LANES))
    out, mask, scale = [], np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for step in range(t, stop):
        x = state[:min(LANES, n - step * LANES)]
        slot = x & mask
        own = table.slots[slot]
        x[:] = table.freq[own] * (x >> scale) + slot - table.first[own]
        low = x < _LOW
        k = int(low.sum())
        x[low] = (x[low] << np.uint64(32)) | words[at:at + k]
        at += k
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_segment(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    symbols, freq = frequencies(flat)
    table = Table(symbols, freq)
    if symbols[-1] < _COUNTED:
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        places = place[flat]
    else:
        places = np.searchsorted(symbols, flat)
    blocks = [encode_block(places[i:i + LANES * STEPS], table) for i in range(0, len(flat), LANES * STEPS)]
    parts = [zlib.compress(np.array(a, k).tobytes()) for a, k in
             ((symbols, "<u4"), (freq, "<u4"), (doc_ids, "<i8"), ([len(x) for x in ids], "<i8"))]
    sizes = [len(p) for p in (*parts, *blocks)]
    return _MAGIC + struct.pack(f"<I{len(sizes)}I", len(sizes), *sizes) + b"".join((*parts, *blocks))


def decode_segment(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document ids of a segment, and the ids of each of them."""
    if data[:len(_MAGIC)] != _MAGIC:
        raise ValueError("not a segment")
    (n,) = struct.unpack_from("<I", data, len(_MAGIC))
    sizes = struct.unpack_from(f"<{n}I", data, len(_MAGIC) + 4)
    ends = np.cumsum(sizes) + len(_MAGIC) + 4 + 4 * n
    parts = [data[e - s:e] for s, e in zip(sizes, ends)]
    symbols, freq, doc_ids, counts = (np.frombuffer(zlib.decompress(p), k) for p, k in zip(parts, ("<u4", "<u4", "<i8", "<i8")))
    table = Table(symbols, freq)
    flat = symbols[np.concatenate([decode_block(b, table) for b in parts[4:]])]
    return doc_ids, np.split(flat, np.cumsum(counts)[:-1])


def write_ids(documents: DataFrame, path: str, out: str, end: int = 2) -> None:
    """Tokenise whole texts and write their ids under ``out``, in ascending doc_id order."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, segment int, n_tokens long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, part = encoder(path, HELD), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        keys: list[int] = []
        held: list[np.ndarray] = []
        number = total = 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()),
                 pa.array([encode_segment(keys, held)], pa.binary())], ["part", "segment", "n_tokens", "data"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist())):
                keys.append(doc_id)
                held.append(np.frombuffer(ids + last, "<u4"))
                total += len(held[-1])
                if total >= SEGMENT:
                    yield segment()
                    keys, held, number, total = [], [], number + 1, 0
        if keys:
            yield segment()

    tie = F.xxhash64("text").alias("tie")
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", tie)
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(out)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of every document under ``out``."""
    made = spark.read.parquet(out)
    totals = made.select("part", "segment", "n_tokens")
    inside = Window.partitionBy("part").orderBy("segment")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("sum"))  # one row for each range of ids
    before = parts.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    starts = totals.join(before, "part").select(
        "part", "segment", (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, ids = decode_segment(row["data"])
                counts = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["part"], np.int32)), pa.array(np.full(len(ids), row["segment"], np.int32)),
                     pa.array(doc_ids), pa.array(np.cumsum(counts) - counts), pa.array(counts),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    ["part", "segment", "doc_id", "local", "n_tokens", "ids"])

    schema = "part int, segment int, doc_id long, local long, n_tokens long, ids binary"
    docs = made.select("part", "segment", "data").mapInArrow(run, schema)
    return docs.withColumn("ids_crc32", F.crc32("ids")).join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids", "ids_crc32")


def round_trip(documents: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write the ids to a new folder in the shared scratch folder and read them back."""
    out = f"{scratch_dir(documents.sparkSession)}/tradeweft/token-ids-{uuid.uuid4().hex}"
    write_ids(documents, path, out, end)
    return read_ids(documents.sparkSession, out)
