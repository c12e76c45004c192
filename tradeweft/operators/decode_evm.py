"""Event logs to swaps, pools and transfers.

Decoding is a projection over the log table: topics and fixed-width words are sliced with
built-in string functions. The topic filter is a plain predicate on ``topic0``, so it
reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions import hexwords as H
from tradeweft.operators.dedup import dispatch, union_protocols

_BASE = ("block_number", "timestamp", "address", "transaction_hash", "transaction_index", "log_index")


def _topic(i: int) -> Column:
    return F.get(F.col("topics"), F.lit(i))


def _word(i: int) -> Column:
    return H.word(F.col("data"), i)


def _none(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


#: What a protocol's event says, as words that are decoded together afterwards: names of the words
#: and of their signs (see :func:`tradeweft.functions.hexwords.decoded`).
_AMOUNTS = {"amount_a": ("_a", "_a_sign"), "amount_b": ("_b", "_b_sign")}
_POOL_STATE = {"pool_sqrt_price_x96": ("_price", None), "pool_liquidity": ("_liquidity", None)}
_NOTHING = "0" * 64


def _either(out: Column, into: Column, side: str) -> list[Column]:
    """``-out`` where something left the pool on this side, else ``in``."""
    left = (F.length(out) == 64) & (out != _NOTHING)
    return [F.when(left, out).otherwise(into).alias(f"_{side}"), left.cast("int").alias(f"_{side}_sign")]


def _two_sided(protocol: str) -> list[Column]:
    return [*[F.col(c) for c in _BASE], F.array(F.lit(protocol)).alias("protocols"),
            _none("string", "pool_id"), H.address(_topic(1)).alias("sender"),
            H.address(_topic(2)).alias("recipient"),
            *_either(_word(2), _word(0), "a"), *_either(_word(3), _word(1), "b"),
            _none("string", "_price"), _none("string", "_liquidity"), _none("int", "pool_tick")]


def _ticked(protocols: list[str], v4: bool) -> list[Column]:
    sign = F.lit(-2 if v4 else 2)
    return [*[F.col(c) for c in _BASE], F.array(*[F.lit(p) for p in protocols]).alias("protocols"),
            (F.lower(_topic(1)) if v4 else F.lit(None).cast("string")).alias("pool_id"),
            H.address(_topic(2) if v4 else _topic(1)).alias("sender"),
            (F.lit(None).cast("string") if v4 else H.address(_topic(2))).alias("recipient"),
            _word(0).alias("_a"), sign.alias("_a_sign"), _word(1).alias("_b"), sign.alias("_b_sign"),
            _word(2).alias("_price"), _word(3).alias("_liquidity"), H.small_int(_word(4)).cast("int").alias("pool_tick")]


def _finished(rows: DataFrame) -> DataFrame:
    """Amounts and pool state from their words."""
    rows = H.decoded(H.decoded(rows, _AMOUNTS), _POOL_STATE, doubles=False)
    return rows.select(*_BASE, "protocols", "pool_id", "sender", "recipient", "amount_a_raw", "amount_a_text", "amount_b_raw",
                       "amount_b_text", *[F.col(f"{c}_text").alias(c) for c in _POOL_STATE], "pool_tick")


def _topic_is(protocol: str) -> Column:
    return F.col("topic0") == K.TOPIC_SWAP[protocol]


def decode_v2_swaps(logs: DataFrame) -> DataFrame:
    return _finished(logs.filter(_topic_is("uniswap_v2")).select(*_two_sided("uniswap_v2")))


def decode_aerodrome_basic(logs: DataFrame) -> DataFrame:
    return _finished(logs.filter(_topic_is("aerodrome_basic")).select(*_two_sided("aerodrome_basic")))


def decode_v3_swaps(logs: DataFrame) -> DataFrame:
    """Signed pool-view amounts. The slipstream family emits the same event."""
    return _finished(logs.filter(_topic_is("uniswap_v3")).select(*_ticked(["uniswap_v3", "aerodrome_slipstream"], False)))


def decode_v4_swaps(logs: DataFrame) -> DataFrame:
    """Amounts are negated to the pool view; the pool is the event id."""
    return _finished(logs.filter(_topic_is("uniswap_v4")).select(*_ticked(["uniswap_v4"], True)))


def decode_swaps(logs: DataFrame) -> DataFrame:
    """Swaps of all protocols in one pass over the logs: each event gives its words, and all words are decoded alike."""
    wanted = logs.filter(F.col("topic0").isin(sorted(set(K.TOPIC_SWAP.values()))))
    return _finished(dispatch(wanted, [
        (_topic_is("uniswap_v2"), _two_sided("uniswap_v2")),
        (_topic_is("aerodrome_basic"), _two_sided("aerodrome_basic")),
        (_topic_is("uniswap_v3"), _ticked(["uniswap_v3", "aerodrome_slipstream"], False)),
        (_topic_is("uniswap_v4"), _ticked(["uniswap_v4"], True))]))


def decode_pools(logs: DataFrame, network: str,
                 factories: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Pool dimension from creation events of the known factories."""
    known = factories or K.FACTORIES[network]
    parts = []
    for protocol, topic in K.TOPIC_POOL_CREATED.items():
        mine = [(dex, addr) for dex, p, addr in known if p == protocol]
        if not mine:
            continue
        dex = None
        for name, addr in mine:
            hit = F.col("address") == addr
            dex = F.when(hit, name) if dex is None else dex.when(hit, name)
        v4 = protocol == "uniswap_v4"
        ta, tb = (_topic(2), _topic(3)) if v4 else (_topic(1), _topic(2))
        pool = {"uniswap_v2": H.address(_word(0)), "uniswap_v3": H.address(_word(1)),
                "uniswap_v4": F.lower(_topic(1)), "aerodrome_basic": H.address(_word(0)),
                "aerodrome_slipstream": H.address(_word(0))}[protocol]
        # Topics carry the 0x prefix; drop it so that a topic reads like a word.
        bare = lambda t: F.substring(t, 3, 64)
        fee = {"uniswap_v3": H.small_int(bare(_topic(3))), "uniswap_v4": H.small_int(_word(0))}.get(protocol)
        spacing = {"uniswap_v3": H.small_int(_word(0)), "uniswap_v4": H.small_int(_word(1)),
                   "aerodrome_slipstream": H.small_int(bare(_topic(3)))}.get(protocol)
        stable = (H.small_int(bare(_topic(3))) == 1) if protocol == "aerodrome_basic" else None
        opt = lambda c, kind, name: (_none(kind, name) if c is None else c.cast(kind).alias(name))
        parts.append(logs.filter((F.col("topic0") == topic)
                                 & F.col("address").isin([a for _, a in mine])).select(
            F.lit(network).alias("network"), dex.alias("dex_name"), F.lit(protocol).alias("protocol"),
            pool.alias("pool"), H.address(ta).alias("token_a"), H.address(tb).alias("token_b"),
            F.col("address").alias("factory_address"), opt(spacing, "int", "tick_spacing"),
            opt(fee, "int", "fee"), opt(stable, "boolean", "stable"),
            "block_number", "transaction_index", "log_index", "transaction_hash"))
    return union_protocols(*parts)


def decode_transfers(logs: DataFrame) -> DataFrame:
    """ERC-20 transfers; logs of another shape (such as NFT transfers) are dropped."""
    shaped = logs.filter((F.col("topic0") == K.TOPIC_TRANSFER) & (F.size("topics") == 3)
                         & (F.length("data") >= 66) & F.col("data").rlike("^0x[0-9a-fA-F]{64}"))
    rows = H.decoded(shaped.withColumn("_amount", _word(0)), {"amount": ("_amount", None)})
    return rows.select(
        "timestamp", F.col("address").alias("token"), H.address(_topic(1)).alias("from_address"),
        H.address(_topic(2)).alias("to_address"), F.col("amount_raw").alias("amount_double"),
        "amount_text", F.col("amount_text").try_cast("decimal(38,0)").alias("amount"),
        "block_number", "transaction_index", "log_index", "transaction_hash", F.lit(1).alias("sign"))
