"""Near-duplicates by a chosen-path set similarity join on minwise tokens.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its
distinct five-word shingles. Equal sets are one class first. Classes then go down ``TREES``
independent trees: a node chooses one or two of the ``TOKENS`` minwise positions (1 / LAMBDA on
average) by the hash of its own key, and every class moves to the child of its value there. First
the classes of each node are compared with the node's first class, so that dense groups become one
component; nodes within one component end there. Then in nodes of up to ``NODE`` classes all pairs
are compared; larger nodes branch again and compare with their first class. What is still large
after ``DEPTH`` levels, or earlier a node of up to ``WIDE`` classes that kept more than half of its
parent's (alike classes, which further levels would only repeat), and not one component, is compared
exhaustively: full sets meet in blocks of bounded size. Elsewhere comparing means: a 128-bit sketch that all but one in a hundred thousand
true pairs pass, then the full sets. Pairs already in one component need no comparison. A class goes by its smallest doc_id (rep).

A pair of similarity 0.75 shares a leaf at depth 1, 2, 3, 4 of one tree with probability 0.81,
0.69, 0.60, 0.53 (the branching recursion), so ten trees miss 5e-8, 9e-6, 1e-4, 5e-4 of them.

Defined results: a null, empty or wordless text has n_shingles 0 and is linked with nothing; a text
of fewer than five words is one shingle; rows without doc_id take no part; repeated rows are
each returned, those of equal texts in one component; ties go to the smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.llm.common import texts_of
from tradeweft.llm.components import joined_roots, smallest
from tradeweft.llm.hashing import blocks, mix, word_hashes
from tradeweft.session import written_table

WORDS, LAMBDA = 5, 0.75
TOKENS, TREES, DEPTH, NODE, WIDE = 128, 10, 5, 32, 2048
#: Members and shingles of a block of a large node.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Bits of 128 in which sketches of a true pair may differ: 16 expected at 0.75, and 4.5 deviations.
SKETCH_BITS = 33
#: Words of 64 bits in the bitmap of documents whose sets are wanted: 2 MB.
BITMAP_WORDS = 1 << 17

_RNG = np.random.default_rng(99)
_PLACES = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XORS = _RNG.integers(0, 2**32, TOKENS, dtype=np.uint32)
_ODDS = _RNG.integers(0, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for a, b in blocks(texts):
        words, bounds = word_hashes(texts[a:b])
        runs = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
        for k in range(WORDS):
            runs += words[k:k + len(runs)] * _PLACES[k]
        runs = mix(runs)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            n = hi - lo
            if n >= WORDS:
                yield np.unique(runs[lo:hi - WORDS + 1])
            elif n:
                yield mix(np.array([(words[lo:hi] * _PLACES[:n]).sum() ^ np.uint64(n)], np.uint64))
            else:
                yield words[:0]


def _minwise(own: np.ndarray) -> np.ndarray:
    x = (own >> np.uint64(32)).astype(np.uint32)
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, ((x[i:i + 4096] ^ _XORS[:, None]) * _ODDS[:, None]).min(axis=1), out=low)
    return low


def _sketch(low: np.ndarray) -> np.ndarray:
    """One bit of a further hash of each minwise value, as two 64-bit numbers."""
    bits = (mix(low.astype(np.uint64) + (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32))) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and for a set that isn't empty its fingerprint, minwise values and sketch."""
    schema = "doc_id long, n_shingles long, class binary, tokens array<int>, s1 long, s2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, tokens, sketches = [], [], [], []
            for own in shingle_sets(texts_of(batch, "text")):
                sizes.append(len(own))
                if not len(own):
                    prints.append(None)
                    tokens.append(None)
                    sketches.append((None, None))
                    continue
                low = _minwise(own)
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                tokens.append(low.view(np.int32))
                sketches.append(tuple(int(v) for v in _sketch(low)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int32())), pa.array([s for s, _ in sketches], pa.int64()),
                 pa.array([s for _, s in sketches], pa.int64())],
                ["doc_id", "n_shingles", "class", "tokens", "s1", "s2"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, schema)


def _child(node: Column, place: Column) -> Column:
    return F.xxhash64(node, place, F.element_at("tokens", place + 1))


def _branch(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows moved from ``node`` to its children; ``rows`` has the minwise values too."""
    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")
    step = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS - 1)).cast("int") + 1
    again = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < int((1 / LAMBDA - 1) * 1_000_000)
    two = F.pmod(one + step, F.lit(TOKENS)).cast("int")
    places = F.when(again, F.array(one, two)).otherwise(F.array(one))
    return (rows.withColumn("place", F.explode(places))
            .select(*keep, _child(F.col("node"), F.col("place")).alias("node")))


def _alike(a1, a2, b1, b2) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2)) <= SKETCH_BITS


def _pair(x, y) -> list[Column]:
    """Two classes, and the roots that their link would join."""
    return [F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b"),
            F.least(x["root"], y["root"]).alias("low"), F.greatest(x["root"], y["root"]).alias("high")]


def _with_first(members: DataFrame) -> DataFrame:
    """Members of nodes with two components or more, with the node's size and first class."""
    first = F.struct("rep", "s1", "s2", "root")
    nodes = (members.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min(first).alias("first"),
                                         F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").drop("low", "high"))
    return members.join(nodes, "node")


def _star_pairs(live: DataFrame) -> DataFrame:
    x, y = {c: F.col(c) for c in ("rep", "s1", "s2", "root")}, F.col("first")
    return live.where((x["root"] != y.root) & _alike(x["s1"], x["s2"], y.s1, y.s2)).select(*_pair(x, y))


def _node_pairs(live: DataFrame) -> DataFrame:
    """All pairs of different components that the sketch passes, in nodes of bounded size."""
    rows = live.groupBy("node").agg(F.collect_list(F.struct("rep", "root", "s1", "s2")).alias("m"))

    def against(x: Column, i: Column) -> Column:
        later = F.slice("m", i + 2, F.size("m"))
        good = F.filter(later, lambda y: (x.root != y.root) & _alike(x.s1, x.s2, y.s1, y.s2))
        return F.transform(good, lambda y: F.struct(*_pair(x, y)))

    return rows.select(F.inline(F.flatten(F.transform("m", against))))


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, own) of the documents in ``wanted`` (rep): sets computed again from their texts.

    Texts are filtered before any shuffle by a bitmap of fixed size over the hashes of their ids.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS * 64))
    bitmap = (wanted.select(bit(F.col("rep")).alias("bit"))
              .groupBy(F.shiftright("bit", 6).alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")))
    texts = (documents.select("doc_id", "text").withColumn("bit", bit(F.col("doc_id")))
             .withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(bitmap), "word")
             .where(F.expr("shiftright(bits, CAST(bit % 64 AS INT)) & 1 = 1")).select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.tobytes() for s in shingle_sets(texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], ["rep", "own"])

    made = texts.mapInArrow(run, "rep long, own binary").join(wanted, "rep", "left_semi")
    return made.withColumn("class", F.xxhash64("own")).dropDuplicates(["rep", "class"]).drop("class")


def _confirmed(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Roots (a, b) of the pairs whose full sets have 100 * intersection >= 75 * union."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = written_table(_sets(documents, written_table(ends, "ends")), "sets")
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("own").alias("y")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= round(100 * LAMBDA) * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("low"), batch.column("high")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written_table(both.select("low", "high", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _joined(documents: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """(key, root) of the roots that confirmed pairs join to smaller ones; None if there are none."""
    pairs = written_table(pairs.distinct(), "pairs")
    return None if pairs.isEmpty() else _roots(_confirmed(documents, pairs))


def _roots(links: DataFrame) -> DataFrame | None:
    return None if links.isEmpty() else joined_roots(links)


def _moved(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Rows with the root that their root was joined to."""
    if joined is None:
        return rows
    to = joined.select(F.col("key").alias("root"), F.col("root").alias("_to"))
    return rows.join(to, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def _in_blocks(large: DataFrame) -> DataFrame:
    """Members of large nodes dealt to every pair of blocks of their node, so that each two meet."""
    n = (F.ceil(F.col("size") / BLOCK) + F.floor(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep", "s1", "node"), n).cast("int")
    return (large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("rep", "root", F.col("own").alias("block"),
                    F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node")))


def _exhaustive(documents: DataFrame, large: DataFrame) -> DataFrame:
    """Roots (a, b) of links within large nodes: full sets meet in blocks, and only links come out."""
    ends = written_table(large.select("rep").distinct(), "ends")
    sets = written_table(_sets(documents, ends), "sets")

    def run(group: pa.Table) -> pa.Table:
        rep, root, block = (group.column(c).to_numpy() for c in ("rep", "root", "block"))
        parts = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("own")]
        sizes = np.array([len(p) for p in parts])
        words, flat = np.unique(np.concatenate(parts), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        held, found = np.zeros(len(words), np.int64), []
        crossing = block.min() != block.max()
        for i in np.flatnonzero(block == block.min()):
            mine = flat[starts[i]:starts[i] + sizes[i]]
            held[mine] = 1
            both = np.add.reduceat(held[flat], starts)
            held[mine] = 0
            good = (100 * both >= round(100 * LAMBDA) * (sizes + sizes[i] - both)) & (root != root[i])
            good &= (block != block[i]) if crossing else (rep > rep[i])
            if good.any():
                found.append(smallest(np.append(root[good], root[i]), np.full(good.sum() + 1, root[i])))
        ends = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 2
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    rows = _in_blocks(large).join(sets, "rep")
    return written_table(rows.groupBy("node").applyInArrow(run, "a long, b long"), "links")


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row with a doc_id."""
    made = written_table(signatures(documents), "signatures")
    classes = written_table(made.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("s1").alias("s1"),
        F.first("s2").alias("s2")), "classes")
    fields = ["rep", "n", "s1", "s2"]
    trees = F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda t: F.xxhash64(F.lit("tree"), t))
    members = _branch(classes.withColumn("node", F.explode(trees)), fields).withColumn("root", F.col("rep"))
    live = written_table(_with_first(members), "live")
    # Dense groups become one component before any other pairs are taken.
    joins = [_joined(documents, _star_pairs(live))]
    live = written_table(_with_first(_moved(live.drop("size", "weight", "first"), joins[0])), "live")
    pairs = _node_pairs(live.where(F.col("size") <= NODE))
    large, own, dense = live.where(F.col("size") > NODE), [*fields, "root", "node"], []
    for _ in range(1, DEPTH):
        if large.isEmpty():
            break
        # A class meets its tokens once for all its nodes, whose number trees and branching bound.
        nodes = large.groupBy(*fields, "root").agg(F.collect_list(F.struct("node", F.col("size").alias("was"))).alias("nodes"))
        rows = (nodes.join(classes.select(*fields, "tokens"), fields).withColumn("of", F.explode("nodes"))
                .select(*fields, "root", "tokens", "of.*"))
        # Members are counted and joined to the counts: written, so that the branching runs once.
        live = written_table(_with_first(written_table(_branch(rows, [*fields, "root", "was"]), "members")), "live")
        small, large = live.where(F.col("size") <= NODE), live.where(F.col("size") > NODE)
        pairs = pairs.union(_node_pairs(small)).union(_star_pairs(large))
        alike = (F.col("size") <= WIDE) & (2 * F.col("size") > F.col("was"))
        dense.append(large.where(alike).select(own))
        large = large.where(~alike)
    joins.append(_joined(documents, pairs))
    large = reduce(DataFrame.union, dense, large.select(own))
    if not large.isEmpty():
        large = written_table(_with_first(_moved(large, joins[-1])), "large")
        joins.append(_roots(_exhaustive(documents, large)))
    named = classes.select("class", F.col("rep").alias("root"))
    for joined in joins:
        named = _moved(named, joined)
    whole = made.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.coalesce("root", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"),
                        (F.col("doc_id") == component).alias("kept"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component, the smallest, with its columns as they are.

    Documents without doc_id are linked with nothing and all stay. Of rows repeated under one doc_id
    that is kept, one stays: the first by its columns.
    """
    named = documents.where("doc_id IS NOT NULL")
    kept = link(named).where("kept").select("doc_id").distinct()
    rest = [c for c in documents.columns if c != "doc_id"]
    one = named.join(kept, "doc_id", "left_semi")
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = one.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    single = one.join(repeated, "doc_id", "left_anti")
    return single.select(documents.columns).unionByName(again.select(documents.columns)).unionByName(documents.where("doc_id IS NULL"))
