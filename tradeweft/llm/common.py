"""Shared small parts: tables, the fold of held-out rows, fitting a model in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from. A row without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rows_of(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    return [row for batch in batches for row in batch.to_pylist()]


def fit_in_task(sample: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """Fit a model on a bounded sample, in one task; the model comes back to the driver.

    The caller bounds ``sample``: this is never used on whole tables.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(fit(rows_of(batches)))
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([])  # a frame without partitions runs no task


def smallest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A sample of ``n`` rows that depends on the keys only: those with the smallest hashes."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
