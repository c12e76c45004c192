"""Roll-up tables that follow corrections of their facts.

Highs, lows, opens and closes cannot be subtracted. So a roll-up is stored in parts (days, or hash
buckets of the token where the roll-up has no time), and after a roll-back or a replay the parts
that the changed rows touch are worked out again from the facts that remain. A part holds all rows of
its keys, so the work follows the size of the touched parts, not that of the table. Only the list of
touched parts comes to the driver: days of the changed rows, or at most ``BUCKETS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweft.plans.rollups import rebuild

BUCKETS = 64
PART = "part"
#: Column of a roll-up, and expression over the swaps, that name a part. Roll-ups by token see a swap from both sides.
_DAYS = {"candles_1m": "bucket_ts", "candles_1m_1usd": "bucket_ts", "candles_10s": "bucket_ts", "pool_stats_1h": "hour_ts", "daily_movers": "day"}
_TOKENS = {"token_swap_counts": ("token", ("token_a", "token_b")), "last_prices": ("token_a", ("token_a",)),
           "tokens_by_creation": ("token_address", ("token_a",))}


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("string")


def _with_part(name: str, rollup: DataFrame) -> DataFrame:
    return rollup.withColumn(PART, _day(F.col(_DAYS[name])) if name in _DAYS else _bucket(F.col(_TOKENS[name][0])))


def touched(name: str, swaps: DataFrame) -> DataFrame:
    """The parts of a roll-up that these swaps belong to."""
    if name in _DAYS:
        return swaps.select(_day(F.col("timestamp")).alias(PART)).distinct()
    sides = F.array(*[_bucket(F.col(c)) for c in _TOKENS[name][1]])
    return swaps.select(F.explode(sides).alias(PART)).distinct()


def _rows_of(name: str, swaps: DataFrame, parts: list[str]) -> DataFrame:
    if name in _DAYS:
        return swaps.filter(_day(F.col("timestamp")).isin(parts))
    hit = F.lit(False)
    for c in _TOKENS[name][1]:
        hit = hit | _bucket(F.col(c)).isin(parts)
    return swaps.filter(hit)


def _drop(spark: SparkSession, folder: str, parts: Iterable[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in parts:
        fs.delete(path(f"{folder}/{PART}={p}"), True)


def store(swaps: DataFrame, folder: str, buy_sign: int = 1, quotes: list[str] | None = None) -> None:
    """Write every roll-up of ``swaps`` in parts under ``folder``."""
    for name, rollup in rebuild(swaps, buy_sign, quotes).items():
        _with_part(name, rollup).write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/{name}")


def refresh(remaining: DataFrame, changed: DataFrame, folder: str, buy_sign: int = 1, quotes: list[str] | None = None) -> dict[str, list[str]]:
    """Bring the stored roll-ups in line with ``remaining``, all facts as they are now.

    ``changed`` holds the rows that were removed or added since. New parts replace old ones; parts
    without rows go last. A call that failed half way may be repeated. Returns the parts worked on.
    """
    spark, done = remaining.sparkSession, {}
    for name in [*_DAYS, *_TOKENS]:
        parts = sorted(r[PART] for r in touched(name, changed).collect())
        done[name] = parts
        if not parts:
            continue
        rollup = _with_part(name, rebuild(_rows_of(name, remaining, parts), buy_sign, quotes)[name]).filter(F.col(PART).isin(parts))
        rollup.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{folder}/{name}")
        left = {r[PART] for r in rollup.select(PART).distinct().collect()}
        _drop(spark, f"{folder}/{name}", [p for p in parts if p not in left])
    return done


def roll_back(swaps: DataFrame, folder: str, from_block: int, replay: DataFrame | None = None, buy_sign: int = 1,
              quotes: list[str] | None = None) -> DataFrame:
    """Take back all rows from ``from_block`` on and put ``replay`` in their place; returns the facts as they are now."""
    gone = swaps.filter(F.col("block_number") >= from_block)
    kept = swaps.filter(F.col("block_number") < from_block)
    now, changed = (kept, gone) if replay is None else (kept.unionByName(replay), gone.unionByName(replay))
    refresh(now, changed, folder, buy_sign, quotes)
    return now


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored roll-up without its parts."""
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{folder}/{name}").drop(PART)
