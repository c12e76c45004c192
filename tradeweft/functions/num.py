"""Number columns: safe division, prices, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` as double, NULL where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(a: Column, b: Column) -> Column:
    return safe_div(a, b) - 1


def human_amount(raw: Column, decimals: Column) -> Column:
    """Token units of a raw integer amount; unknown decimals count as 18."""
    return raw.cast("double") / F.pow(F.lit(10.0), F.coalesce(decimals, F.lit(18)))


def pair_price(amount_a: Column, amount_b: Column) -> Column:
    """Price of A in B."""
    return F.abs(safe_div(amount_b, amount_a))


def reserve_price(reserve_0: Column, reserve_1: Column) -> Column:
    return safe_div(reserve_0, reserve_1)


def sqrt_x64_price(sqrt_price: Column, decimals_a: Column, decimals_b: Column) -> Column:
    """Price from a 64-bit fixed-point square root price."""
    root = sqrt_price.cast("double") / F.lit(2.0 ** 64)
    return root * root * F.pow(F.lit(10.0), (decimals_a - decimals_b).cast("double"))


def net_return(price: Column, entry: Column, fee: Column, slippage: Column) -> Column:
    return safe_div(price, entry) * (1 - fee - slippage) - 1


def decimal_string(raw: Column, decimals: Column) -> Column:
    """Integer amount as a decimal string with ``decimals`` digits after the point."""
    text = raw.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(text, "^-", "")
    n = F.length(digits)
    small = F.concat(sign, F.lit("0."), F.lpad(digits, decimals, F.lit("0")))
    large = F.concat(sign, F.substring(digits, F.lit(1), n - decimals), F.lit("."),
                     F.substring(digits, n - decimals + 1, decimals))
    return F.when(decimals == 0, text).when(n <= decimals, small).otherwise(large)
