"""Row collapse, replace and set operations. All are hash aggregates or anti-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(df: DataFrame, keys: Sequence[str], sign: str = "sign") -> DataFrame:
    """Cancel +1 / -1 rows per key; a key stays (once) when its signs sum to more than 0.

    The surviving row is the latest written +1 row only in engines that merge; here the
    +1 rows of a key are copies of each other, so any of them is the row.
    """
    rest = [c for c in df.columns if c not in keys and c != sign]
    agg = df.groupBy(*keys).agg(
        F.sum(sign).alias("_total"), *[F.any_value(F.when(F.col(sign) > 0, F.col(c)), True).alias(c)
                                       for c in rest])
    return agg.filter("_total > 0").select(
        *[F.lit(1).alias(sign) if c == sign else F.col(c) for c in df.columns])


def replace_latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep the row with the highest ``version`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")) \
        .select(*keys, "_r.*").select(*df.columns)


def sum_merge(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def insert_ignore(dim: DataFrame, new: DataFrame, keys: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Add keys that ``dim`` does not have; the first of several new rows wins."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")) \
        .select(*keys, "_r.*")
    return dim.unionByName(first.join(dim.select(*keys), list(keys), "left_anti").select(*dim.columns))


def union_protocols(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dispatch(df: DataFrame, handlers: Sequence[tuple[Column, Sequence[Column]]]) -> DataFrame:
    """Apply the first handler whose predicate holds: ``(predicate, projection)`` pairs.

    One pass: the chosen projection is exploded from a one-element array, so the input is
    read once however many handlers there are. Rows without a handler are dropped.
    """
    chosen = None
    for predicate, projection in handlers:
        row = F.struct(*projection)
        chosen = F.when(predicate, row) if chosen is None else chosen.when(predicate, row)
    return df.select(chosen.alias("_h")).filter(F.col("_h").isNotNull()).select("_h.*")


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def sample_distinct(df: DataFrame, column: str, n: int) -> DataFrame:
    """``n`` distinct values, the smallest ones, so that a run can be repeated."""
    return df.select(column).distinct().orderBy(column).limit(n)


def rollback(df: DataFrame, latest, ts: str = "timestamp") -> DataFrame:
    """State after a chain rollback: rows up to ``latest``."""
    return df.filter(F.col(ts) <= F.lit(latest).cast("timestamp"))


def retractions(df: DataFrame, latest, ts: str = "timestamp") -> DataFrame:
    """The ``sign = -1`` copies that take back everything after ``latest``."""
    return df.filter((F.col(ts) > F.lit(latest).cast("timestamp")) & (F.col("sign") > 0)) \
        .withColumn("sign", F.lit(-1))
