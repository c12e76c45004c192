"""Time columns. All bucketing is in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit.
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds_of(interval: str) -> int:
    """``'10 seconds'`` -> 10."""
    n, unit = interval.split()
    return int(n) * _SECONDS[unit.lower().rstrip("s")]


def bucket(ts: Column, interval: str) -> Column:
    """Start of the ``interval`` (aligned to the epoch) that holds ``ts``."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds_of(interval))))


def yyyymm(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def prev_hour(ts: Column) -> Column:
    """Start of the hour before the one that holds ``ts``."""
    return bucket(ts - F.expr("INTERVAL 1 HOUR"), "1 hour")


def to_unix(ts: Column) -> Column:
    return F.unix_seconds(ts)


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def ago(now: Column, n: int, unit: str) -> Column:
    """``now`` minus ``n`` units; ``now`` is always an argument, so results can be repeated."""
    return now - F.expr(f"INTERVAL {int(n)} {unit.upper()}")


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries between two times (not the number of full units)."""
    width = F.lit(_SECONDS[unit])

    def index(ts: Column) -> Column:
        s = F.unix_seconds(ts)
        return ((s - F.pmod(s, width)) / width).cast("long")

    return index(end) - index(start)
