"""Phrases whose words occur together more often than apart, by an FM-index per shard.

A shard is some megabytes of texts. Its words get numbers, and its pieces (runs of words without
punctuation or line ends) stand one after the other with 0 between them. Over that sequence lie two
Burrows-Wheeler transforms, one of the sequence and one of its reverse, in the order of the first
``words - 1`` symbols (longer contexts never matter, since phrases are no longer). A phrase is a pair
of intervals, one in each; :meth:`Index.right` and :meth:`Index.left` extend all intervals at once by
every symbol that follows or precedes, with its number of occurrences.

Counts are exact: every shard gives all of its phrases of two words that occur often anywhere, the
counts are summed over shards, each shard hears which of them are frequent, extends those alone, and
so on. A phrase is frequent only if the phrases inside it are, so nothing is lost. Between shards and
sums travel blocks, of one shard and one hash bucket of phrases each: sorted ids of words and counts,
packed; back comes one bit for each phrase. A bucket holds about ``BUCKET`` phrases whatever the size
of the corpus. Shards keep the numbers of their words, not the transforms: ordering them again costs
less than moving them.

Defined results: a null text is empty; a null lang is ``und``; rows without doc_id count as any other;
repeated rows count each; an empty table gives no phrases; other columns are not read. Ties in score
go to the larger count, then to the smaller phrase in UTF-8 byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.llm.common import texts_of
from tradeweft.llm.hashing import cut_words, distinct, mix
from tradeweft.session import written_table

#: Bytes of text in a shard, and phrases in a bucket.
SHARD, BUCKET = 10 << 20, 2_000_000
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd"), kind)


class Index:
    """Two transforms of a sequence of symbols, 0 between pieces and at both ends, with intervals.

    Intervals are three arrays: start in the order of the sequence, start in the order of the reverse,
    size. They are in ascending order of their phrases' symbols.
    """

    def __init__(self, symbols: np.ndarray, size: int, depth: int):
        self.size, self.depth = size, depth
        self.symbols = symbols.astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=size))])
        self._places: np.ndarray | None = None
        self._before: np.ndarray | None = None
        self._behind: np.ndarray | None = None

    def _transform(self, s: np.ndarray) -> np.ndarray:
        """The symbol before each suffix, suffixes ordered by their first ``depth - 1`` symbols."""
        rank, width = s, 1
        while width < self.depth - 1:
            step = min(width, self.depth - 1 - width)
            pair = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
            width += step
            if width < self.depth - 1:
                rank = np.unique(pair, return_inverse=True)[1]
            else:
                rank = pair
        return np.roll(s, 1)[np.argsort(rank, kind="stable")]

    @property
    def before(self) -> np.ndarray:
        if self._before is None:
            self._before = self._transform(self.symbols)
        return self._before

    @property
    def behind(self) -> np.ndarray:
        if self._behind is None:
            self._behind = self._transform(self.symbols[::-1])
        return self._behind

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of all single symbols but 0."""
        return self.firsts[1:-1], self.firsts[1:-1], np.diff(self.firsts)[1:]

    def _extend(self, transform: np.ndarray, at: np.ndarray, other: np.ndarray, sizes: np.ndarray):
        """Parent, symbol, start on the side of the new symbol, start on the other side, size."""
        parents = np.repeat(np.arange(len(at)), sizes)
        ends = np.cumsum(sizes)
        rows = np.arange(len(parents)) + np.repeat(at - ends + sizes, sizes)
        keys = np.sort(parents * self.size + transform[rows])
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate([heads, [len(keys)]]))
        parent, symbol = np.divmod(keys[heads], self.size)
        across = other[parent] + heads - (ends - sizes)[parent]
        keep = symbol > 0
        return parent[keep], symbol[keep], across[keep], counts[keep]

    def right(self, intervals):
        """All phrases one symbol longer at the end, as parents, symbols, start in the sequence's order, sizes."""
        forward, backward, sizes = intervals
        return self._extend(self.behind, backward, forward, sizes)

    def left(self, intervals):
        """All phrases one symbol longer at the front, as parents, symbols, starts in both orders, sizes."""
        forward, backward, sizes = intervals
        parent, symbol, across, counts = self._extend(self.before, forward, backward, sizes)
        return parent, symbol, self.step(symbol, forward[parent]), across, counts

    def step(self, symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that have ``symbol`` before those from ``start`` on."""
        if self._places is None:
            n = len(self.symbols)
            self._places = np.sort(self.before * n + np.arange(n))
        return np.searchsorted(self._places, symbol * len(self.symbols) + start)


def frequent_only(index: Index, masks: list[np.ndarray], order) -> tuple[list[np.ndarray], tuple, np.ndarray]:
    """Phrases of ``len(masks) + 2`` words as columns of symbols, their intervals and sizes.

    ``masks[k]`` tells which phrases of ``k + 2`` words are frequent anywhere, in the order that
    ``order`` gives them. A phrase is listed if the phrases inside it are frequent.
    """
    one, back, sizes = index.words()
    parent, symbol, forward, counts = index.right((one, back, sizes))
    columns = [parent + 1, symbol]
    # the start in the reverse's order is never asked for: from here on phrases grow at the front
    state = (forward, np.zeros(len(forward), np.int64), counts)
    for mask in masks:
        keep = np.zeros(len(columns[0]), bool)
        keep[order(columns)] = mask
        columns, state = [c[keep] for c in columns], tuple(x[keep] for x in state)
        parent, symbol, forward, across, counts = index.left(state)
        # the front part of a phrase, from its first to its last but one word, has to be frequent too
        by_start = np.argsort(state[0])
        starts, ends = state[0][by_start], (state[0] + state[2])[by_start]
        near = np.searchsorted(starts, forward, "right") - 1
        keep = (near >= 0) & (forward < ends[np.maximum(near, 0)]) if len(starts) else np.zeros(len(forward), bool)
        columns = [symbol[keep], *[c[parent[keep]] for c in columns]]
        state = (forward[keep], across[keep], counts[keep])
    return columns, state, state[2]


def _buckets(columns: list[np.ndarray], n: int) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * _ODD + c.astype(np.uint64))
    return (key % np.uint64(n)).astype(np.int64)


def _parts(text: bytes) -> Iterator[bytes]:
    """A very long text in parts, cut behind the end of a piece."""
    while len(text) > SHARD:
        ends = np.flatnonzero(_ENDS[np.frombuffer(text, np.uint8, SHARD)])
        if not len(ends):
            more = np.flatnonzero(_ENDS[np.frombuffer(text, np.uint8)])
            ends = more[:1]
            if not len(ends):
                break
        yield text[:ends[-1] + 1]
        text = text[ends[-1] + 1:]
    yield text


def numbered(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """The sequence of symbols of some texts, and language, word and count of each symbol from 1 on."""
    raw, starts, ends, hashes, bounds = cut_words(texts, _GAPS, _FOLD)
    code = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    own = np.repeat(np.array([code[lang] for lang in langs], np.int64), np.diff(bounds))
    first, kind = distinct(raw, starts, ends, hashes ^ mix(own.astype(np.uint64) + np.uint64(1)))
    piece = np.searchsorted(np.flatnonzero(_ENDS[raw]), starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(starts)]] = True
    places = np.arange(len(starts)) + np.cumsum(fresh)
    sequence = np.zeros(len(starts) + int(fresh.sum()) + 1, np.int32)
    sequence[places] = kind + 1
    data, names = raw.tobytes(), list(code)
    words = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return sequence, [names[i] for i in own[first].tolist()], words, np.bincount(kind, minlength=len(first))


_SHARD = "shard long, symbol int, lang string, word string, n long, data binary"


def _shards(documents: DataFrame) -> DataFrame:
    """Rows of shards (symbol 0: the packed sequence and its length) and of their symbols."""
    def made(part: int, number: int, texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
        sequence, own, words, counts = numbered(texts, langs)
        n = len(words)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + number] * (n + 1), pa.int64()), pa.array(np.arange(n + 1), pa.int32()),
             pa.array([None, *own], pa.string()), pa.array([None, *words], pa.string()),
             pa.array([len(sequence), *counts.tolist()], pa.int64()), pa.array([pack(sequence), *[None] * n], pa.binary())],
            ["shard", "symbol", "lang", "word", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, texts, langs, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
                for own in _parts(text):
                    if held + len(own) > SHARD and texts:
                        yield made(part, number, texts, langs)
                        number, texts, langs, held = number + 1, [], [], 0
                    texts.append(own)
                    langs.append(lang)
                    held += len(own) + 64
        if texts:
            yield made(part, number, texts, langs)

    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SHARD)


def _with_ids(words: DataFrame) -> DataFrame:
    """Words with dense numbers ``id`` from 0 on."""
    spark = words.sparkSession
    rows = written_table(words.withColumn("row", F.monotonically_increasing_id()), "words")
    part = F.shiftright("row", 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect())  # one row per partition
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    if starts[-1] >= 1 << 32:
        raise ValueError("more than 2 ** 32 frequent words")
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part long, start long")
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        (F.col("start") + F.col("row") - F.shiftleft(F.col("part"), 33)).alias("id"), "lang", "word", "n")


_BLOCK = "bucket long, shard long, n long, ids binary, counts binary"


def _phrases(index: pa.Table, info: pa.Table, level: int, buckets: int) -> pa.Table:
    """Blocks of the phrases of ``level`` words of one shard."""
    rows = {"bucket": [], "shard": [], "n": [], "ids": [], "counts": []}
    if len(index) and len(info):  # a side without rows comes without columns
        kinds = info.column("level").to_numpy()
        known = info.filter(pa.array(kinds == 1))
        symbol, ids = known.column("symbol").to_numpy(), known.column("id").to_numpy()
        ids_up = np.sort(ids)
        length = index.column("n")[0].as_py()
        sequence = unpack(index.column("data")[0].as_py(), length, "int32")
        renamed = np.zeros(int(sequence.max()) + 1, np.int64)
        renamed[symbol] = np.searchsorted(ids_up, ids) + 1
        masks = []
        for k in range(2, level):
            own = info.filter(pa.array(kinds == k)).sort_by("bucket")
            bits = [np.unpackbits(np.frombuffer(data, np.uint8), count=n)
                    for data, n in zip(own.column("data").to_pylist(), own.column("n").to_pylist())]
            masks.append(np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool))

        def order(columns):
            return np.argsort(_buckets([ids_up[c - 1] for c in columns], buckets), kind="stable")

        columns, _, counts = frequent_only(Index(renamed[sequence], len(ids_up) + 1, level), masks, order)
        columns = [ids_up[c - 1].astype(np.uint32) for c in columns]
        place = _buckets(columns, buckets)
        turn = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[turn], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(turn)]):
            at = turn[a:b]
            rows["bucket"].append(int(place[at[0]]))
            rows["shard"].append(index.column("shard")[0].as_py())
            rows["n"].append(len(at))
            rows["ids"].append(pack(np.concatenate([c[at] for c in columns])))
            rows["counts"].append(pack(counts[at].astype(np.uint32)))
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), "shard": pa.array(rows["shard"], pa.int64()),
                     "n": pa.array(rows["n"], pa.int64()), "ids": pa.array(rows["ids"], pa.binary()),
                     "counts": pa.array(rows["counts"], pa.binary())})


def _summed(blocks: pa.Table, level: int, least: int) -> pa.Table:
    """Adds up the blocks of one bucket: the bits of each block, and one row of the frequent phrases."""
    sizes = blocks.column("n").to_pylist()
    parts = [unpack(d, n * level, "uint32").reshape(level, n) for d, n in zip(blocks.column("ids").to_pylist(), sizes)]
    counts = np.concatenate([unpack(d, n, "uint32") for d, n in zip(blocks.column("counts").to_pylist(), sizes)]).astype(np.int64)
    columns = np.concatenate(parts, axis=1).astype(np.int64)
    key = columns[0]
    for c in columns[1:-1]:
        key = np.unique((key << 32) | c, return_inverse=True)[1]
    _, first, kind = np.unique((key << 32) | columns[-1], return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, kind, counts)
    good = total >= least
    bits = np.split(good[kind], np.cumsum(sizes)[:-1])
    found = first[good]
    return pa.table({
        "bucket": pa.array([*blocks.column("bucket").to_pylist(), blocks.column("bucket")[0].as_py()], pa.int64()),
        "shard": pa.array([*blocks.column("shard").to_pylist(), None], pa.int64()),
        "n": pa.array([*sizes, len(found)], pa.int64()),
        "ids": pa.array([*[np.packbits(b).tobytes() for b in bits], pack(columns[:, found].ravel())], pa.binary()),
        "counts": pa.array([*[None] * len(bits), pack(total[good])], pa.binary())})


def _functions(level: int, buckets: int, least: int):
    return (lambda index, info: _phrases(index, info, level, buckets)), (lambda blocks: _summed(blocks, level, least))


def _rows_of(summed: DataFrame, level: int) -> DataFrame:
    """Frequent phrases as rows: w1, w2, ... and a."""
    names = [f"w{k + 1}" for k in range(level)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "counts"))):
                columns = unpack(ids, n * level, "int64").reshape(level, n)
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(unpack(counts, n, "int64"))], [*names, "a"])

    found = summed.filter(F.col("shard").isNull()).select("n", "ids", "counts")
    return found.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"]))


def phrase_counts(documents: DataFrame, words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, dict[int, DataFrame]]:
    """Words of each language in total (lang, total), the frequent words (id, lang, word, n), and the
    frequent phrases of 2 to ``words`` words by their number of words (w1, w2, ..., a)."""
    rows = written_table(_shards(documents), "shards")
    texts = rows.filter("symbol = 0").select("shard", "n", "data")
    symbols = rows.filter("symbol > 0").select("shard", "symbol", "lang", "word", "n")
    totals = symbols.groupBy("lang").agg(F.sum("n").alias("total"))
    counted = symbols.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    known = written_table(_with_ids(counted), "known")
    size = texts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards")).first()
    buckets, parts = (size["n"] or 0) // BUCKET + 1, max(1, size["shards"])
    info = symbols.join(known.select("lang", "word", "id"), ["lang", "word"]).select(
        F.col("shard").alias("owner"), F.lit(1).alias("level"), "symbol", "id", F.lit(None).cast("long").alias("bucket"),
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"))
    info = written_table(info, "ids")
    found: dict[int, DataFrame] = {}
    for level in range(2, words + 1):
        blocks, summed = _functions(level, buckets, least)
        made = texts.repartition(parts, "shard").groupBy("shard").cogroup(
            info.repartition(parts, "owner").groupBy("owner")).applyInArrow(blocks, _BLOCK)
        done = written_table(made.repartition(min(buckets, 8 * parts), "bucket").groupBy("bucket").applyInArrow(summed, _BLOCK), "phrases")
        found[level] = _rows_of(done, level)
        if level < words:
            info = info.unionByName(done.filter(F.col("shard").isNotNull()).select(
                F.col("shard").alias("owner"), F.lit(level).alias("level"), F.lit(None).cast("int").alias("symbol"), F.lit(None).cast("long").alias("id"),
                "bucket", "n", F.col("ids").alias("data")))
    return totals, known, found


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact for counts below 10 ** 14."""
    a, left, right = (f"CAST({c} AS DECIMAL(14,0))" for c in ("a", left, right))
    return F.expr(f"({a} * {a} * CAST(1000000 AS DECIMAL(7,0))) DIV ({left} * {right})")


def collocations(documents: DataFrame, words: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of up to ``words`` words has to occur ``least`` times; it is dropped where a longer one
    that holds it has at least ``inside`` hundredths of its occurrences.
    """
    totals, known, found = phrase_counts(documents, words, least)
    parts = {1: known.select(F.col("id").alias("w1"), F.col("n").alias("a")), **found}
    rated = []
    for level, phrases in found.items():
        names = [f"w{k + 1}" for k in range(level)]
        cuts = []
        for k in range(1, level):
            for side, own in (("l", names[:k]), ("r", names[k:])):
                piece = parts[len(own)].select(*[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(own)], F.col("a").alias(f"{side}{k}"))
                phrases = phrases.join(piece, own)
            cuts.append(F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        phrases = phrases.withColumn("cut", F.array_min(F.array(*cuts)))
        if level + 1 in found:
            longer = found[level + 1]
            ends = [longer.select(*[F.col(f"w{k + 1 + shift}").alias(f"w{k + 1}") for k in range(level)], "a") for shift in (0, 1)]
            most = ends[0].union(ends[1]).groupBy(*names).agg((F.max("a") * 100).alias("most"))
            phrases = phrases.join(most, names, "left").filter(F.coalesce(F.col("most") < F.col("a") * inside, F.lit(True)))
        rated.append(phrases.select(*names, *[F.lit(None).cast("long").alias(f"w{k + 1}") for k in range(level, words)],
                                    "a", "cut.score", "cut.l", "cut.r"))
    rows = rated[0]
    for more in rated[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(known.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1")), "w1")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = rows.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place")
    for k in range(2, words + 1):
        rows = rows.join(known.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"word{k + 1}" for k in range(words)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
