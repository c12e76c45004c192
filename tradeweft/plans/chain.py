"""From raw chain tables to fact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions.keys import CHAIN_ORDER
from tradeweft.operators.decode_evm import decode_pools, decode_swaps, decode_transfers
from tradeweft.operators.dedup import insert_ignore
from tradeweft.operators.enrich import with_pool, with_tokens, with_tx
from tradeweft.operators.filters import positionable
from tradeweft.operators.holders import first_transfers, holder_counts, holder_snapshots
from tradeweft.operators.positions import extend_positions
from tradeweft.operators.pricing import price_evm, price_quote
from tradeweft.session import written_table


def evm_swaps(logs: DataFrame, transactions: DataFrame, network: str, tokens: DataFrame | None = None,
              pools: DataFrame | None = None, only_pools: bool = False) -> dict[str, DataFrame]:
    """Pools (known ones plus those created in these logs; the first row wins) and, unless
    ``only_pools``, decoded swaps with pool, sender and token data."""
    created = decode_pools(logs, network)
    known = created.filter("false") if pools is None else pools
    dim = insert_ignore(known, created, ["network", "pool"], ["block_number", "transaction_index", "log_index"])
    out = {"pools": dim}
    if only_pools:
        return out
    swaps = with_tx(with_pool(decode_swaps(logs), dim), transactions)
    out["swaps"] = swaps if tokens is None else with_tokens(swaps, tokens)
    return out


#: Columns that roll-ups read and that a chain may not have.
_OPTIONAL = {"slippage_pct": "double", "token_a_creation_date": "timestamp", "token_b_creation_date": "timestamp",
             "pool_token_a_reserve": "double", "pool_token_b_reserve": "double"}


def evm_facts(swaps: DataFrame, network: str, order: Sequence[str] = CHAIN_ORDER,
              refs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Decoded swaps with prices and both-sided positions, and the columns that the roll-ups read.

    Decoded and priced swaps are written once each: several passes read them, and the plan of a pass
    stays as small as its own work. ``refs``: (token, reference pool), the stablecoin first.
    """
    refs = list(refs or K.REFERENCE_TOKENS[network])
    more = {c: F.lit(None).cast(kind) for c, kind in _OPTIONAL.items()} | {"sign": F.lit(1), "dex": F.col("dex_name")}
    base = written_table(swaps.withColumns({c: v for c, v in more.items() if c not in swaps.columns}), "swaps")
    priced = written_table(price_evm(base, refs, refs[0][0], order=order), "priced")
    return extend_positions(priced, buy_sign=-1, both_sides=True, order=order, eps=1e-10,
                            eligible=F.col("token_a_usdc_price") > 0)


def solana_facts(swaps: DataFrame, quotes: list[str] | None = None, stables: list[str] | None = None,
                 order: Sequence[str] = ("block_number", "transaction_index", "instruction_address")) -> DataFrame:
    """Trader-view swaps with prices and positions of token A against quote tokens."""
    priced = written_table(price_quote(written_table(swaps, "swaps"), quotes, stables, order), "priced")
    return extend_positions(priced, buy_sign=1, both_sides=False, order=order, eligible=positionable(quotes))


def transfer_facts(logs: DataFrame, interval: str = "5 minutes") -> dict[str, DataFrame]:
    """Transfers, first transfers and holder snapshots from event logs."""
    transfers = decode_transfers(logs)
    counts = holder_counts(transfers, amount="amount_text")
    return {"transfers": transfers, "first_transfers": first_transfers(transfers),
            "holders": holder_snapshots(counts, interval)}
