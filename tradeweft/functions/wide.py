"""Integers wider than any Spark type, as a few DECIMAL limbs.

A value is the sum of limb ``i`` times 10 ** (27 i); all limbs carry the value's sign. Sums are taken
limb by limb, exact for 10 ** 11 rows, and only then carried over, so that grouped sums, running sums
and comparisons work on values of 256 bits. Two limbs hold any DECIMAL(38,0), three any 256-bit integer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 27
_BASE, _LIMB = 10 ** DIGITS, "decimal(38,0)"
_SMALL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _dec(value: int) -> Column:
    return F.lit(str(value)).cast(_LIMB)


def limb_count(kind: T.DataType) -> int:
    if isinstance(kind, _SMALL) or (isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= DIGITS):
        return 1
    return 2 if isinstance(kind, T.DecimalType) and kind.scale == 0 else 3


def _over(total: Column) -> Column:
    """Whole multiples of the base, towards zero: at most 10 ** 11 of them."""
    return F.call_function("div", total, _dec(_BASE))


def _rest(total: Column) -> Column:
    """What is left of them, with the sign of the total."""
    return total % _dec(_BASE)


def limbs(value: Column, count: int) -> list[Column]:
    """Limbs of an integer, the lowest first: a number for up to two limbs, else a number or decimal text."""
    if count == 1:
        return [value.cast("decimal(27,0)")]
    if count == 2:
        whole = value.cast(_LIMB)
        return [_rest(whole).cast("decimal(27,0)"), _over(whole).cast("decimal(27,0)")]
    text = value.cast("string")
    negative = text.startswith("-")
    bare = F.when(negative | text.startswith("+"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    digits = F.lpad(bare, DIGITS * count, "0")
    out = []
    for i in range(count):
        limb = F.substring(digits, 1 + DIGITS * (count - 1 - i), DIGITS).cast("decimal(27,0)")
        out.append(F.when(negative, -limb).otherwise(limb))
    return out


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def carried(sums: Column, count: int) -> Column:
    """An array of limbs of any size and sign, carried: from 0 to the base, the highest one signed."""
    def step(state: Column, limb: Column) -> Column:
        def split(total: Column) -> Column:
            # a multiple of the base: shifting the point by text keeps it exact
            return _let(F.pmod(total, _dec(_BASE)).cast(_LIMB), lambda rest: F.struct(
                _shifted((total - rest).cast(_LIMB).cast("string")).alias("carry"),
                F.concat(state["done"], F.array(rest)).alias("done")))
        return _let((limb + state["carry"]).cast(_LIMB), split)

    start = F.struct(_dec(0).alias("carry"), F.array().cast(f"array<{_LIMB}>").alias("done"))
    return _let(sums, lambda own: F.aggregate(
        F.slice(own, 1, count - 1), start, step,
        lambda s: F.concat(s["done"], F.array((F.get(own, count - 1) + s["carry"]).cast(_LIMB)))))


def _shifted(text: Column) -> Column:
    return F.when(F.length(text) <= DIGITS, F.lit(0)).otherwise(F.substring(text, F.lit(1), F.length(text) - DIGITS)).cast(_LIMB)


def _array(sums: Sequence[Column]) -> Column:
    return F.array(*[s.cast(_LIMB) for s in sums])


def sign(sums: Sequence[Column]) -> Column:
    """-1, 0 or 1. Limbs that agree in sign need no carrying; plain arithmetic, so that it is compiled."""
    if len(sums) == 1:
        return F.signum(sums[0]).cast("int")
    parts, carry = [], F.lit(0)
    for limb in sums[:-1]:
        total = (limb + carry).cast(_LIMB)
        parts.append(_rest(total))
        carry = _over(total)
    parts.append((sums[-1] + carry).cast(_LIMB))
    # the highest part that is not zero outweighs those below it
    by_parts = F.signum(parts[0]).cast("int")
    for part in parts[1:]:
        by_parts = F.when(part > 0, 1).when(part < 0, -1).otherwise(by_parts)
    low, high = F.least(*[s.cast(_LIMB) for s in sums]), F.greatest(*[s.cast(_LIMB) for s in sums])
    agreed = F.when(low >= 0, F.when(high > 0, 1).otherwise(0)).when(high <= 0, -1)
    return F.coalesce(agreed, by_parts, F.lit(0))


def digits(limbs: Sequence[Column]) -> Column:
    """Decimal text of limbs as :func:`limbs` gives them (one sign, none beyond the base), perhaps with leading zeros."""
    if len(limbs) == 1:
        return limbs[0].cast(_LIMB).cast("string")
    long = F.concat(*[F.lpad(F.abs(limb).cast("string"), DIGITS, "0") for limb in reversed(limbs)])
    return F.concat(F.when(F.least(*limbs) < 0, "-").otherwise(""), F.lit("0"), F.ltrim(long, F.lit("0")))


def text(sums: Sequence[Column]) -> Column:
    """Canonical decimal text."""
    if len(sums) == 1:
        return sums[0].cast(_LIMB).cast("string")
    count = len(sums)

    def of(row: Column) -> Column:
        plain = _let(carried(F.transform(row["limbs"], lambda limb: (limb * row["sign"]).cast(_LIMB)), count), lambda flat: F.concat(
            F.get(flat, count - 1).cast("string"),
            F.array_join(F.reverse(F.transform(F.slice(flat, 1, count - 1), lambda limb: F.lpad(limb.cast("string"), DIGITS, "0"))), "")))
        return F.concat(F.when(row["sign"] < 0, "-").otherwise(""), F.regexp_replace(plain, "^0+(?=[0-9])", ""))

    return _let(F.struct(_array(sums).alias("limbs"), sign(sums).alias("sign")), of)


def to_double(sums: Sequence[Column]) -> Column:
    total = sums[0].cast("double")
    for i, limb in enumerate(sums[1:], 1):
        total = total + limb.cast("double") * F.lit(float(_BASE ** i))
    return total
