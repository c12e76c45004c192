"""Order keys and direction of a trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chain order of the rows of a fact table.
CHAIN_ORDER = ("timestamp", "transaction_index", "log_index")
#: Chain order where the last part is a path of instruction indexes.
PATH_ORDER = ("timestamp", "transaction_index", "instruction_address")


def order_key(*columns: str) -> Column:
    """Comparable struct of the given columns (default: chain order)."""
    return F.struct(*(columns or CHAIN_ORDER))


def packed_order_key(ts: str = "timestamp", tx: str = "transaction_index",
                     log: str = "log_index") -> Column:
    """The chain order as one DECIMAL(38,0): microseconds, transaction, log.

    Aggregation buffers of a fixed-width type keep ``min_by`` / ``max_by`` on the hash
    aggregate; a struct key would force a sort of all rows. Both indexes stay below 10^10.
    """
    def dec(c: Column, digits: int) -> Column:
        return c.cast(f"decimal({digits},0)")

    micros = dec(F.unix_micros(F.col(ts)), 17) * F.lit("100000000000000000000").cast("decimal(21,0)")
    return (micros + dec(F.col(tx).cast("long") * 1, 10) * F.lit("10000000000").cast("decimal(11,0)")
            + dec(F.col(log).cast("long"), 10)).cast("decimal(38,0)")


def packed_path(path: Column, depth: int = 5) -> Column:
    """An instruction path as one number that sorts like the array.

    A transaction runs at most 64 instructions, nested at most five deep, so three
    decimal digits per level hold ``index + 1`` and 0 stands for "no such level". A deeper path
    or a larger index raises, as its number would be another path's.
    """
    total = F.lit(0).cast("long")
    for level in range(depth):
        digit = F.coalesce(F.get(path, F.lit(level)).cast("long") + 1, F.lit(0))
        total = total + digit * F.lit(1000 ** (depth - 1 - level))
    fits = (F.size(path) <= depth) & F.forall(path, lambda i: i < 999)
    return F.when(fits, total).otherwise(F.raise_error(F.lit("instruction path does not fit its key")).cast("long"))


def path_order_key(block: str = "block_number", tx: str = "transaction_index", path: str = "instruction_address") -> Column:
    """Block, transaction and instruction path as one DECIMAL(38,0), for chains whose rows have a path.

    The block comes first: several blocks may share a second. A block stays below 10^17, a
    transaction's index below 10^6.
    """
    def dec(c: Column, digits: int) -> Column:
        return c.cast(f"decimal({digits},0)")

    return (dec(F.col(block).cast("long"), 17) * F.lit("1000000000000000000000").cast("decimal(22,0)")
            + dec(F.col(tx).cast("long"), 6) * F.lit("1000000000000000").cast("decimal(16,0)")
            + dec(packed_path(F.col(path)), 15)).cast("decimal(38,0)")


def schema_order_key(swaps: DataFrame) -> Column:
    """The packed order key that the columns of ``swaps`` allow: by log index, or by instruction path."""
    return packed_order_key() if "log_index" in swaps.columns else path_order_key()


def is_buy(amount_a: Column, buy_sign: int) -> Column:
    """True where the trader buys A. ``buy_sign`` is +1 (trader view) or -1 (pool view)."""
    return (amount_a > 0) if buy_sign > 0 else (amount_a < 0)


def is_sell(amount_a: Column, buy_sign: int) -> Column:
    return (amount_a < 0) if buy_sign > 0 else (amount_a > 0)
