"""Byte-level BPE by Spark higher-order functions.

A task cuts its texts into the distinct pieces of the split pattern (a row of pieces, then a row
for each text with the numbers of its pieces). Spark's higher-order functions encode each distinct
piece: a fold over its bytes that merges the pair of the lowest rank, leftmost first, until no pair
has a rank. The fold's state is one array of numbers, a token each: the rank of its pair with the next
token, then its place, then its id, so that the smallest number is the next pair to merge. The rank map
is a literal: for every pair of tokens that together make a token, that token's rank, in an array with a
perfect hash, since Spark searches its maps from their start. Rows
keep their order between the steps of the one stage, so that the ids of a text are put together
without a shuffle. Decoding looks the ids up in a literal array and concatenates the binary pieces,
which travel as text of one character (0 to 255) for each byte.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are independent, so
that repeated rows give repeated results; any bytes can be encoded, as every byte has a rank.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.llm.tokens import _BYTE_LEVEL, units

#: Ranks are below 2 ** 17; a pair of them is one number.
SHIFT = 1 << 17
_NONE = 2**31 - 1
#: A token in the fold has 18 bits of its pair's rank (``SHIFT``: no rank), 27 of its place in the piece and 18 of its
#: id; the id ``SHIFT`` stands before the first and behind the last.
_ID, _PLACED = 18, 45
_LOW, _REST, _DONE = (1 << _ID) - 1, (1 << _PLACED) - 1, SHIFT << _PLACED
_EDGE = _DONE | SHIFT
#: In a free slot: agrees with no pair.
_FREE = (1 << 62) - 1
#: Characters of text whose pieces are made distinct together, pieces in a row, and distinct pieces
#: after which a task forgets which it has had; until then each is folded once per task.
GROUP, ROW, KNOWN = 2 << 20, 2048, 400_000
#: Two coprime moduli whose product is above every pair: no two pairs agree in both.
_COARSE, _FINE = 65_537, 524_287
#: Texts that are Python objects at once, and ids that a row batch collects.
TEXTS, IDS = 512, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _letters(data: bytes) -> str:
    return data.decode("latin-1")


def fold(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in plain Python, for single pieces."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        low, i = min((ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if low == _NONE:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class RankMap:
    """Literals for Spark and what a worker needs: the bytes' ids, and tokens that merging misses."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= SHIFT:
            raise ValueError(f"ranks must be below {SHIFT}")
        self.ranks = ranks
        pairs = {ranks[t[:i]] << _ID | ranks[t[i:]]: rank for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.starts = np.array([[ranks.get(bytes([a, b]), SHIFT) for b in range(256)] for a in range(256)], np.int64)
        self.missed = {t: rank for t, rank in ranks.items() if fold(t, ranks) != [rank]}
        self.size = 1 << max(8, (len(pairs) * 3 // 2).bit_length())
        self.shifts, self.slots = self._place(pairs)

    def _place(self, pairs: dict[int, int]) -> tuple[list[int], list[int]]:
        """Shift of each coarse bucket that sends its pairs to free slots, and the filled slots."""
        buckets: dict[int, list[int]] = {}
        for key in pairs:
            buckets.setdefault(key % _COARSE, []).append(key)
        shifts, slots = [0] * _COARSE, [_FREE] * self.size
        for coarse, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            fine = [k % _FINE for k in keys]
            for turn in range(self.size):
                shift = (coarse * 7919 + turn * 104_729) % self.size
                places = {(f + shift) % self.size for f in fine}
                if len(places) == len(fine) and all(slots[p] == _FREE for p in places):
                    break
            else:
                raise ValueError("no free slots for a bucket of pairs")
            shifts[coarse] = shift
            for k, f in zip(keys, fine):
                slots[(f + shift) % self.size] = k << 17 | pairs[k]
        return shifts, slots

    def columns(self):
        """A function from a column of two ranks (the left one above ``_ID`` bits) to the rank of the token they make, or ``SHIFT``."""
        shifts = F.from_json(F.lit(json.dumps(self.shifts)), "array<int>")
        slots = F.from_json(F.lit(json.dumps(self.slots)), "array<bigint>")

        def of_key(key: Column) -> Column:
            slot = (key % _FINE + F.get(shifts, (key % _COARSE).cast("int"))).bitwiseAND(self.size - 1).cast("int")
            return F.least(F.get(slots, slot).bitwiseXOR(F.shiftleft(key, 17)), F.lit(SHIFT).cast("bigint"))

        return of_key


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), 0)


def encode_piece(tokens: Column, ranks: RankMap) -> Column:
    """Ids of a piece of the split pattern, given as the fold's first state (see :func:`start_states`)."""
    rank_of, long = ranks.columns(), lambda n: F.lit(n).cast("bigint")

    def merge(state: Column, _: Column) -> Column:
        def at(low: Column, i: Column) -> Column:  # i from 1; the merged token's id is its rank
            made = F.shiftright(low, _PLACED)
            before = F.get(state, i - 2)
            keys = F.array(F.shiftleft(before.bitwiseAND(long(_LOW)), _ID).bitwiseOR(made),
                           F.shiftleft(made, _ID).bitwiseOR(F.get(state, i + 1).bitwiseAND(long(_LOW))))
            rest = lambda side: F.when(side == 0, before.bitwiseAND(long(_REST))).otherwise(
                low.bitwiseAND(long(_REST - _LOW)).bitwiseOR(made))
            near = F.transform(keys, lambda key, side: F.shiftleft(rank_of(key), _PLACED).bitwiseOR(rest(side)))
            return F.concat(F.slice(state, F.lit(1), i - 2), near, F.slice(state, i + 2, F.size(state)))

        return _let(F.array_min(state), lambda low: F.when(low >= long(_DONE), state).otherwise(
            _let(F.array_position(state, low).cast("int"), lambda i: at(low, i))))

    return F.aggregate(F.slice(tokens, 4, F.size(tokens)), tokens, merge, lambda s: F.transform(
        F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(long(_LOW)).cast("int")))


def start_states(pieces: list[bytes], known: list[int], byte_ids: np.ndarray, pairs: np.ndarray) -> pa.ListArray:
    """The fold's first state of each piece: its bytes between two edges, or one token where its id is known (not -1)."""
    known = np.array(known, np.int64)
    data = [b"\0" if k >= 0 else p for p, k in zip(pieces, known.tolist())]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    if len(sizes) and sizes.max() >= 1 << (_PLACED - _ID):
        raise ValueError(f"a piece has {sizes.max()} bytes")
    flat, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes)
    begins = ends - sizes
    ids = byte_ids[flat].astype(np.int64)
    ids[begins[known >= 0]] = known[known >= 0]
    rank = np.full(len(flat), SHIFT, np.int64)
    rank[:-1] = pairs[flat[:-1], flat[1:]]
    rank[ends - 1] = SHIFT
    offsets = np.concatenate([[0], ends + 2 * np.arange(1, len(data) + 1)])
    out = np.full(len(flat) + 2 * len(data), _EDGE, np.int64)
    out[np.arange(len(flat)) + np.repeat(2 * np.arange(len(data)) + 1, sizes)] = (
        rank << _PLACED | (np.arange(len(flat)) - np.repeat(begins, sizes)) << _ID | ids)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


class _Numbers(dict):
    """Piece -> its number as a little-endian 32-bit integer, in the order in which pieces are first asked for."""

    def __missing__(self, piece: bytes) -> bytes:
        number = self[piece] = len(self).to_bytes(4, "little")
        return number


class _Splitter:
    """Words to pieces of the split pattern; words of letters with stops behind them without the pattern, where it allows that."""

    def __init__(self, pattern: str):
        self.split, self.plain = regex.compile(pattern), pattern == _BYTE_LEVEL

    def __call__(self, word: bytes) -> list[bytes]:
        if self.plain:
            core = word.rstrip(b".,!")
            bare = core[1:] if core[:1] == b" " else core
            if bare.isalpha() or bare and not bare.isascii() and (text := bare.decode()).isalpha() and max(text) < "\u0250":
                return [core] if len(core) == len(word) else [core, word[len(core):]]
        return [p.encode() for p in self.split.findall(word.decode())]


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    for start in range(0, batch.num_rows, TEXTS):
        yield from batch.column("text").slice(start, TEXTS).to_pylist()


def encode(documents: DataFrame, ranks: RankMap, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    missed, byte_ids, pairs = ranks.missed, np.array(ranks.bytes, np.int32), ranks.starts
    breaks = np.zeros(256, bool)
    breaks[32] = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, numbers = _Splitter(pattern), _Numbers()
        for batch in batches:
            doc_ids, at = batch.column("doc_id"), 0
            for group in units(_texts(batch), breaks, True, GROUP):
                if len(numbers) > KNOWN:
                    numbers = _Numbers()
                before = len(numbers)
                runs = group.laid_out([b"".join([numbers[p] for p in split(word)]) for word in group.words()])
                new = list(islice(reversed(numbers), len(numbers) - before))[::-1]
                states = start_states(new, [missed.get(p, -1) for p in new], byte_ids, pairs)
                rows = -(-len(new) // ROW)
                cuts = [*range(0, len(new), ROW), *[None] * len(runs), len(new)]  # none in the rows of texts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * rows + doc_ids.slice(at, len(runs)).to_pylist(), pa.int64()),
                     pa.array([None] * rows + runs, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), states),
                     pa.array([before == 0 and i == 0 for i in range(rows + len(runs))], pa.bool_())],
                    ["doc_id", "run", "pieces", "anew"])
                at += len(runs)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes, held, fresh = np.empty(0, np.int32), np.empty(0, np.int64), [], False
        begins, doc_ids, ids, total = sizes, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        for batch in batches:
            runs, codes, anew = batch.column("run"), batch.column("codes"), batch.column("anew").to_pylist()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                if codes[i].is_valid:  # a row of pieces; numbers go on from the rows before, or start anew
                    own = codes[i].values
                    held = [] if anew[i] else held
                    held.append((own.flatten().to_numpy(zero_copy_only=False), np.diff(own.offsets.to_numpy())))
                    fresh = True
                    continue
                if fresh:
                    flat, sizes = (np.concatenate(x) for x in zip(*held))
                    begins, fresh, held = np.cumsum(sizes) - sizes, False, [(flat, sizes)]
                run = np.frombuffer(runs[i].as_buffer(), "<u4")
                counts = sizes[run]
                stops = np.cumsum(counts)
                doc_ids.append(doc_id)
                ids.append(flat[np.repeat(begins[run] - stops + counts, counts) + np.arange(stops[-1] if len(run) else 0)])
                total += len(ids[-1])
                if total >= IDS:
                    yield made()
                    doc_ids, ids, total = [], [], 0
        yield made()

    pieces = documents.select("doc_id", "text").mapInArrow(cut, "doc_id long, run binary, pieces array<array<bigint>>, anew boolean")
    coded = pieces.select("doc_id", "run", "anew", F.transform("pieces", lambda p: encode_piece(p, ranks)).alias("codes"))
    return coded.mapInArrow(gather, "doc_id long, ids array<int>")


def decode(ids: Column, ranks: RankMap) -> Column:
    """The bytes that ids stand for."""
    by_rank = dict(sorted((rank, _letters(piece)) for piece, rank in ranks.ranks.items()))
    table = F.from_json(F.lit(json.dumps([by_rank.get(i) for i in range(max(by_rank) + 1)])), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")
