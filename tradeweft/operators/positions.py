"""First-in-first-out positions per (account, token), without a sequential loop.

With ``B`` = units bought so far, ``S`` = units sold so far and ``L`` = sells that met no
balance, the sold units are ``E = S - L``. Buys and sells then lie on one axis of units:
a buy covers the units up to its ``B``, a sell the units up to its ``E``. The cost of the
first ``x`` units (over buys) and their revenue (over sells) are piecewise linear, so

* cost of a sell = cost(E) - cost(E before it); profit = its revenue - its cost;
* profit of a lot = revenue(B) - revenue(B before it) - its cost; it closes at the first
  sell with ``E >= B`` and is a win when the profit is positive, else a loss.

Units and money are DECIMAL(38,18), so that running sums don't drift. A token whose amounts leave the
range of that type (a total of 10^18 units or more, or amounts below 10^-12) is counted in units of a power
of ten, which puts its total just below 10^18: 34 digits from the total of a token down to its smallest
amount count. Amounts that are no finite number change nothing. All running values come from
:mod:`tradeweft.operators.ordered`: one account may hold any share of the rows. Accounts of usual size are
partitioned by key once and pass all orders in their task; only large ones are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions import keys as OK
from tradeweft.operators.ordered import Chunks, Scan, by_size, chunk, scan
from tradeweft.session import written_table

KEYS = ("account", "token")
QTY = "decimal(38,18)"
MONEY = "decimal(38,18)"
# A lot whose profit is below this share of its cost counts as closed at zero profit.
_ZERO_PROFIT = 1e-12
_RESULT = ("balance", "cost", "profit", "wins", "losses")
# Totals below 10^_TOP and amounts from _LEAST on need no unit of their own.
_TOP, _LEAST = 18, 1e-12
_FINITE = 1.7976931348623157e308


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _with_unit(rows: DataFrame, token: str) -> DataFrame:
    """Add ``_k``: amounts of the row's token are counted in units of 10 ** ``_k``, mostly 1.

    Only tokens out of range are kept, written first: Spark then knows their size and broadcasts them when
    they are few.
    """
    total = F.sum("_qty")
    odd = (rows.filter("_qty > 0").groupBy(F.col(token).alias("_unit_of"))
           .agg((F.ceil(F.log10(total)) - _TOP).cast("int").alias("_k"),
                ((total >= 10.0 ** _TOP) | (F.min("_qty") < _LEAST)).alias("_odd")))
    odd = written_table(odd.filter("_odd").drop("_odd"), "units")
    rows_k = rows.join(odd, F.col(token).eqNullSafe(F.col("_unit_of")), "left")
    return rows_k.select(*rows.columns, F.coalesce("_k", F.lit(0)).alias("_k"))


def _in_units(amount: Column, k: Column) -> Column:
    """``amount / 10 ** k``, by moving the exponent of its text: decimal digits stay as they are."""
    parts = F.split(amount.cast("string"), "E")
    exponent = F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)) - k
    moved = F.concat(F.get(parts, F.lit(0)), F.lit("E"), exponent.cast("string"))
    return F.when(k == 0, amount.cast(QTY)).otherwise(moved.cast(QTY))


def _size_of_unit(k: Column) -> Column:
    return F.pow(F.lit(10.0), k)


def _parts(legs: DataFrame, keys: Sequence[str], order: Sequence[str], eps: float) -> list[Chunks]:
    """Rows in time order with their running values: keys of usual size as a whole, large ones in chunks."""
    qty = F.abs(F.col("amount")).cast("double")
    valid = (qty > eps) & (qty <= _FINITE) & (F.col("price") > eps)
    rows = legs.withColumn("_qty", F.when(valid, qty).otherwise(0.0))
    return [_running(t) for t in by_size(_with_unit(rows, keys[-1]), keys, order)]


def _running(t: Chunks) -> Chunks:
    """Add bought, sold and effective units and running money; chunks are written with them, to be read twice."""
    t = t.map(t.df.withColumn("_q", _in_units(F.col("_qty"), F.col("_k"))).withColumn(
        "_p", F.col("price").cast("double") * _size_of_unit(F.col("_k"))))
    b = F.when(F.col("is_buy"), F.col("_q")).otherwise(F.lit(0).cast(QTY))
    s = F.when(F.col("is_buy"), F.lit(0).cast(QTY)).otherwise(F.col("_q"))
    t = t.map(t.df.withColumn("_bq", b).withColumn("_sq", s))
    net = F.col("_sq") - F.col("_bq")
    t = scan(t, Scan("_bt", "sum", F.col("_bq")), Scan("_st", "sum", F.col("_sq")),
             Scan("_mx", "peak", net), Scan("_m0", "peak", net, strict=True))
    zero = F.lit(0).cast(QTY)
    e = (F.col("_st") - F.greatest(F.col("_mx"), zero)).cast(QTY)
    e0 = (F.col("_st") - F.col("_sq") - F.greatest(F.coalesce(F.col("_m0"), zero), zero)).cast(QTY)
    t = t.map(t.df.withColumn("_et", e).withColumn("_eff", (F.col("_et") - e0).cast(QTY))
              .withColumn("_bt", F.col("_bt").cast(QTY)))
    rows = (t.df.withColumn("_cost", _money(F.col("_bq").cast("double") * F.col("_p")))
            .withColumn("_rev", _money(F.col("_eff").cast("double") * F.col("_p"))))
    return t.map(rows if t.whole else written_table(rows, "running"))


def _axis(t: Chunks, payload: Sequence[str]) -> Chunks:
    """Lots and effective sells on the axis of units, with their neighbours resolved.

    Each lot row gets ``rev_at`` (revenue up to its end, NULL while open), each sell row
    ``cost_at`` (cost up to its end); ``*_before`` are the values at the previous one. A whole chunk keeps its
    other rows, with no place on the axis, and goes through no further shuffle.
    """
    keys, bought, sold = t.keys, F.col("_bq") > 0, F.col("_eff") > 0
    row = F.struct(*payload)
    rows = t.df.select(
        *keys, F.when(bought, F.col("_bt")).when(sold, F.col("_et")).alias("_x"),
        F.when(bought, F.struct(F.col("_p").alias("p"), F.col("_k").alias("k"), F.col("_cost").alias("cost"),
                                F.col("_carry_pnl").alias("pnl0"))).alias("_lot"),
        F.when(sold, F.struct(F.col("_p").alias("p"), F.col("_rev").alias("rev"))).alias("_sell"),
        (row if t.whole else F.when(sold, row)).alias("_row"))
    a = chunk(rows if t.whole else rows.filter("_x IS NOT NULL"), keys, ["_x"], t.n)
    x, zero_q, zero = F.col("_x"), F.lit(0).cast(QTY), F.lit(0).cast(MONEY)
    is_lot, is_sell = F.col("_lot").isNotNull(), F.col("_sell").isNotNull()
    # backwards first: the scans after it then share one sort
    a = scan(a, Scan("_lot_price", "last", F.col("_lot.p"), reverse=True, peers=True),
             Scan("_sell_price", "last", F.col("_sell.p"), reverse=True, peers=True))
    a = scan(a, Scan("_lots_cost", "sum", F.col("_lot.cost"), peers=True),
             Scan("_lots_end", "last", F.when(is_lot, x), peers=True),
             Scan("_sells_rev", "sum", F.col("_sell.rev"), peers=True),
             Scan("_sells_end", "last", F.when(is_sell, x), peers=True))

    def at(total: str, end: str, price: str) -> Column:
        # value of all whole pieces up to here, plus the part of the piece that follows
        gap = (x - F.coalesce(F.col(end), zero_q)).cast("double")
        return _money(F.coalesce(F.col(total), zero)
                      + F.when(gap > 0, _money(gap * F.col(price))).otherwise(zero))

    reached = F.col("_sell_price").isNotNull()
    a = a.map(a.df.withColumn("_cost_at", F.when(is_sell, at("_lots_cost", "_lots_end", "_lot_price")))
              .withColumn("_rev_at", F.when(is_lot & reached, at("_sells_rev", "_sells_end", "_sell_price"))))
    a = scan(a, Scan("_cost_before", "last", F.col("_cost_at"), strict=True),
             Scan("_rev_before", "last", F.col("_rev_at"), strict=True),
             Scan("_x_before", "last", F.when(is_lot, x), strict=True))
    pnl = _money(F.col("_rev_at") - F.coalesce(F.col("_rev_before"), zero) - F.col("_lot.cost")
                 + F.col("_lot.pnl0"))
    closed = F.col("_rev_at").isNotNull()
    won = pnl.cast("double") > F.col("_lot.cost").cast("double") * _ZERO_PROFIT
    a = a.map(a.df.withColumn("_won", F.when(closed & won, 1).otherwise(0))
              .withColumn("_lost", F.when(closed & ~won, 1).otherwise(0)))
    return scan(a, Scan("_wins", "sum", F.col("_won"), peers=True),
                Scan("_losses", "sum", F.col("_lost"), peers=True))


def _prepare(legs: DataFrame, opening: DataFrame | None, keys: Sequence[str],
             order: Sequence[str]) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    legs = legs.withColumn("_opening", F.lit(0)).withColumn("_carry_pnl", zero) \
        .withColumn("_wins0", F.lit(0).cast("long")).withColumn("_losses0", F.lit(0).cast("long"))
    if opening is None:
        return legs
    lots = opening.select(
        *keys, F.lit(True).alias("is_buy"), F.col("amount").cast("double").alias("amount"),
        F.col("price").cast("double").alias("price"), (F.col("lot_no") - 2_000_000_000).alias("_opening"),
        F.col("realized_profit").cast(MONEY).alias("_carry_pnl"),
        F.col("wins").alias("_wins0"), F.col("losses").alias("_losses0"))
    return legs.unionByName(lots, allowMissingColumns=True)


def fifo_positions(legs: DataFrame, keys: Sequence[str] = KEYS,
                   order: Sequence[str] = OK.CHAIN_ORDER, eps: float = 0.0,
                   opening: DataFrame | None = None) -> DataFrame:
    """Add ``balance, cost, profit, wins, losses`` after each row.

    ``legs`` has the keys, a unique order inside a key, ``is_buy``, ``amount`` (its size
    counts) and ``price``. Rows whose amount or price is not above ``eps`` change nothing.
    ``opening`` is a :func:`open_lots` snapshot to start from.
    """
    columns = [c for c in legs.columns]
    parts = _parts(_prepare(legs, opening, keys, order), keys, ["_opening", *order], eps)
    return reduce(DataFrame.unionByName, [_positions(t, columns) for t in parts])


def _positions(t: Chunks, columns: Sequence[str]) -> DataFrame:
    keys = t.keys
    keep = [c for c in columns if c not in keys]
    state = [*keep, "_opening", "_bt", "_et", "_rev", "_wins0", "_losses0", "_k", "_chunk", "_pos"]
    a = _axis(t, [F.col(c) for c in state])
    zero, is_sell = F.lit(0).cast(MONEY), F.col("_sell").isNotNull()
    cost = F.col("_cost_at") - F.coalesce(F.col("_cost_before"), zero)

    def of_sell(value: Column, other: Column) -> Column:
        return F.when(is_sell, value).otherwise(other)

    rows = a.df.select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in state],
        of_sell(cost.cast("double"), F.lit(0.0)).alias("cost"),
        of_sell((F.col("_row._rev") - cost).cast("double"), F.lit(0.0)).alias("profit"),
        of_sell(F.col("_wins"), F.lit(None)).alias("_w"), of_sell(F.col("_losses"), F.lit(None)).alias("_l"),
        (~is_sell).alias("_rest"))
    if not t.whole:  # lots come from their own place in time, as do rows that are not on the axis
        rows = rows.filter("NOT _rest").unionByName(t.df.filter(F.col("_eff") <= 0).select(
            *keys, *state, F.lit(0.0).alias("cost"), F.lit(0.0).alias("profit"),
            F.lit(None).cast("long").alias("_w"), F.lit(None).cast("long").alias("_l"), F.lit(True).alias("_rest")))
    # rows that are equal in the order: sells first, as they were sold
    done = scan(replace(t, df=rows, order=(*t.order, "_rest", "_et")),
                Scan("_ww", "last", F.col("_w")), Scan("_ll", "last", F.col("_l")),
                Scan("_w0", "max", F.col("_wins0")), Scan("_l0", "max", F.col("_losses0")))
    return done.df.filter(F.col("_opening") == 0).select(
        *columns, ((F.col("_bt") - F.col("_et")).cast("double") * _size_of_unit(F.col("_k"))).alias("balance"),
        "cost", "profit",
        (F.coalesce(F.col("_ww"), F.lit(0)) + F.col("_w0")).cast("long").alias("wins"),
        (F.coalesce(F.col("_ll"), F.lit(0)) + F.col("_l0")).cast("long").alias("losses"))


def open_lots(legs: DataFrame, keys: Sequence[str] = KEYS,
              order: Sequence[str] = OK.CHAIN_ORDER, eps: float = 0.0,
              opening: DataFrame | None = None) -> DataFrame:
    """Snapshot of the position state: the unsold rest of each lot, oldest first.

    Keys without an open lot keep one row of amount 0, so that wins and losses survive.
    """
    parts = _parts(_prepare(legs, opening, keys, order), keys, ["_opening", *order], eps)
    return reduce(DataFrame.unionByName, [_open(t) for t in parts])


def _open(t: Chunks) -> DataFrame:
    keys = t.keys
    a = _axis(t, [F.col("_pos")])
    totals = t.df.groupBy(*keys).agg(
        F.max("_et").alias("_sold"), F.sum("_rev").cast(MONEY).alias("_revenue"),
        F.max("_wins0").alias("_w0"), F.max("_losses0").alias("_l0"))
    counts = a.df.groupBy(*keys).agg(F.sum("_won").alias("_w"), F.sum("_lost").alias("_l"))
    lots = a.df.filter(F.col("_lot").isNotNull() & F.col("_rev_at").isNull()).select(
        *keys, F.col("_x"), F.col("_lot.p").alias("price"), _size_of_unit(F.col("_lot.k")).alias("_unit"), F.col("_lot.pnl0").alias("_pnl0"),
        F.coalesce(F.col("_x_before"), F.lit(0).cast(QTY)).alias("_from"),
        F.coalesce(F.col("_rev_before"), F.lit(0).cast(MONEY)).alias("_rev_from"))
    state = totals.join(counts, list(keys), "left").join(lots, list(keys), "left")
    start = F.greatest(F.col("_from"), F.col("_sold"))
    used = F.greatest(F.col("_sold") - F.col("_from"), F.lit(0).cast(QTY))
    realized = F.when(used > 0, F.col("_revenue") - F.col("_rev_from")
                      - _money(used.cast("double") * F.col("price"))).otherwise(F.lit(0).cast(MONEY))
    rows = state.select(
        *keys, F.coalesce((F.col("_x") - start).cast("double") * F.col("_unit"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.col("price") / F.col("_unit"), F.lit(0.0)).alias("price"),
        F.coalesce((realized + F.col("_pnl0")).cast("double"), F.lit(0.0)).alias("realized_profit"),
        (F.coalesce(F.col("_w"), F.lit(0)) + F.col("_w0")).alias("wins"),
        (F.coalesce(F.col("_l"), F.lit(0)) + F.col("_l0")).alias("losses"),
        F.coalesce(F.col("_x"), F.lit(0).cast(QTY)).alias("_x"))
    numbered = scan(chunk(rows, keys, ["_x"]), Scan("lot_no", "sum", F.lit(1)))
    return numbered.map(numbered.df.drop("_x")).rows()


def position_legs(swaps: DataFrame, buy_sign: int, both_sides: bool,
                  order: Sequence[str] = OK.CHAIN_ORDER) -> DataFrame:
    """Position movements of a swap: token A, and token B as the opposite side."""
    buys = OK.is_buy(F.col("amount_a"), buy_sign)

    def leg(side: str, buy: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), F.col(f"token_{side}").alias("token"),
            F.col(f"amount_{side}").cast("double").alias("amount"),
            F.col(f"token_{side}_usdc_price").alias("price"), buy.alias("is_buy"))

    legs = [leg("a", buys)] + ([leg("b", ~buys)] if both_sides else [])
    return swaps.select("account", *order, F.explode(F.array(*legs)).alias("_leg")) \
        .select("account", *order, "_leg.*")


def extend_positions(swaps: DataFrame, buy_sign: int = 1, both_sides: bool = False,
                     order: Sequence[str] = OK.CHAIN_ORDER, eps: float = 0.0,
                     eligible: Column | None = None) -> DataFrame:
    """Swaps with ``token_{a,b}_{balance,cost_usdc,profit_usdc,wins,loses}``.

    Rows outside ``eligible`` keep zeros. Token B columns stay 0 unless ``both_sides``.
    """
    fit = swaps if eligible is None else swaps.filter(eligible)
    legs = position_legs(fit, buy_sign, both_sides, order)
    res = fifo_positions(legs, order=order, eps=eps)
    names = {"balance": "balance", "cost": "cost_usdc", "profit": "profit_usdc",
             "wins": "wins", "losses": "loses"}
    # Both legs of a swap share its order key; fold them back into one row, then join.
    wide = res.groupBy("account", *order).agg(*[
        F.max(F.when(F.col("side") == side, F.col(src))).alias(f"token_{side}_{dst}")
        for side in ("a", "b") for src, dst in names.items()])
    out = swaps.join(wide, ["account", *order], "left")
    fill = {f"token_{s}_{d}": 0 for s in ("a", "b") for d in names.values()}
    return out.fillna(fill)
