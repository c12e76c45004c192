"""Connected components of a graph given by its edges, by repeated stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft.session import written_table

#: Edges that a task contracts together.
TOGETHER = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices that are not the smallest of their component, and the smallest, of a few edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars (a, its smallest vertex b) of the components within blocks of edges, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            ends = [np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in smallest(*ends)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                yield made()
        if held:
            yield made()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _is_flat(pairs: DataFrame) -> bool:
    """True when every vertex has one root and no root has another: nothing can move any more."""
    ends = pairs.select(F.col("a").alias("key"), "b").union(pairs.select("b", F.lit(None).cast("long")))
    seen = ends.groupBy("key").agg(F.min("b").alias("low"), F.max("b").alias("high"),
                                   F.max(F.col("b").isNull()).alias("into"))
    return seen.where("low <> high OR (into AND low IS NOT NULL)").isEmpty()


def joined_roots(edges: DataFrame) -> DataFrame:
    """(key, root) of every vertex that is not the smallest of its component: that one is its root.

    ``edges`` has columns a and b of type long. Blocks of edges are contracted first. Then large stars (a
    vertex's larger neighbours move to its smallest one) and small stars (its smaller neighbours do) take
    turns until each vertex hangs on its root; each round is written to the shared folder. Smallest
    neighbours are aggregates with a map-side step, so that a vertex with very many edges is no single task.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.union(pairs.select("b", "a")) if large else pairs
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = near.join(low, "a")
        out = moved.where("b > a" if large else "b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if large:  # equal pairs go in the small star that follows
            return out.where("a <> b")
        return out.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    pairs = written_table(_contracted(edges).distinct(), "star")
    while not _is_flat(pairs):
        pairs = written_table(star(star(pairs, True), False), "star")
    return pairs.select(F.col("a").alias("key"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every vertex, with the smallest vertices themselves."""
    joined = joined_roots(edges)
    return joined.union(joined.select(F.col("root").alias("key"), "root").distinct())
