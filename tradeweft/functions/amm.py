"""Expected amounts and slippage of the market maker formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweft.functions.num import safe_div

# 25 / 10000 constant-product fee.
FEE = 25
FEE_DENOMINATOR = 10_000


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def cp_exact_in(amount_in: Column, reserve_in: Column, reserve_out: Column,
                fee: int = FEE) -> Column:
    """Expected output of a constant-product pool for an exact input, rounded down.

    Exact while every product fits 38 digits, else the double quotient.
    """
    keep = FEE_DENOMINATOR - fee
    with_fee = F.try_multiply(_dec(amount_in), F.lit(keep).cast("decimal(5,0)"))
    num = F.try_multiply(with_fee.cast("decimal(38,0)"), _dec(reserve_out))
    den = F.try_add(F.try_multiply(_dec(reserve_in), F.lit(FEE_DENOMINATOR).cast("decimal(5,0)")),
                    with_fee)
    return _int_div(num, den,
                    amount_in.cast("double") * keep * reserve_out.cast("double"),
                    reserve_in.cast("double") * FEE_DENOMINATOR + amount_in.cast("double") * keep)


def cp_exact_out(amount_out: Column, reserve_in: Column, reserve_out: Column,
                 fee: int = FEE) -> Column:
    """Expected input of a constant-product pool for an exact output, rounded down."""
    keep = FEE_DENOMINATOR - fee
    num = F.try_multiply(F.try_multiply(_dec(reserve_in), _dec(amount_out)),
                         F.lit(FEE_DENOMINATOR).cast("decimal(5,0)"))
    left = F.try_subtract(_dec(reserve_out), _dec(amount_out))
    den = F.try_multiply(left, F.lit(keep).cast("decimal(5,0)"))
    return _int_div(num, den,
                    reserve_in.cast("double") * amount_out.cast("double") * FEE_DENOMINATOR,
                    (reserve_out.cast("double") - amount_out.cast("double")) * keep)


def _int_div(num: Column, den: Column, num_d: Column, den_d: Column) -> Column:
    num, den = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    # (num - num mod den) is a multiple of den, so the rounded division of it is exact.
    whole = F.try_divide(num - F.try_mod(num, den), den)
    rough = F.try_divide(num_d, den_d)
    # Doubles above 2^53 are whole already (and would not fit the BIGINT of floor).
    rough = F.when(F.abs(rough) < 2.0 ** 53, F.floor(rough).cast("double")).otherwise(rough)
    return F.coalesce(F.round(whole, 0).cast("double"), rough)


def slippage_exact_in(expected_out: Column, amount_out: Column) -> Column:
    return safe_div(expected_out - amount_out, expected_out) * 100


def slippage_exact_out(amount_in: Column, expected_in: Column) -> Column:
    return safe_div(amount_in - expected_in, expected_in) * 100


def slippage_pre(amount_in: Column, amount_out: Column, pre_price: Column, a_to_b: Column) -> Column:
    """Slippage against the price before the swap; human amounts."""
    expected = F.when(a_to_b, amount_in * pre_price).otherwise(safe_div(amount_in, pre_price))
    return safe_div(expected - amount_out, expected) * 100


def slippage_post(amount_in: Column, amount_out: Column, post_price: Column,
                  zero_for_one: Column) -> Column:
    """Slippage against the price after the swap; human amounts. Often negative."""
    expected = F.when(zero_for_one, safe_div(amount_out, post_price)).otherwise(amount_out * post_price)
    return safe_div(amount_in - expected, expected) * 100


def curve_price(curve: Column, virtual_base: Column, virtual_quote: Column, real_base: Column,
                real_quote: Column, decimals_base: Column, decimals_quote: Column) -> Column:
    """Bonding-curve price: 0 constant product, 1 fixed price, 2 linear."""
    vb, vq = virtual_base.cast("double"), virtual_quote.cast("double")
    rb, rq = real_base.cast("double"), real_quote.cast("double")
    scale = F.pow(F.lit(10.0), (decimals_base - decimals_quote).cast("double"))
    return (F.when(curve == 0, safe_div(vq + rq, vb - rb))
            .when(curve == 1, safe_div(vq, vb))
            .when(curve == 2, vb * rb / F.lit(2.0 ** 64))) * scale


def curve_paid_price(is_buy: Column, amount_in: Column, amount_out: Column, fees: Column,
                     decimals_base: Column, decimals_quote: Column) -> Column:
    """Price really paid on a bonding curve, fees taken out."""
    scale = F.pow(F.lit(10.0), (decimals_base - decimals_quote).cast("double"))
    return F.when(is_buy, safe_div(amount_in - fees, amount_out)) \
        .otherwise(safe_div(amount_out + fees, amount_in)) * scale


def curve_slippage(is_buy: Column, paid: Column, before: Column) -> Column:
    return F.when(is_buy, F.lit(100.0)).otherwise(F.lit(-100.0)) * (safe_div(paid, before) - 1)
