"""Fixed-width hex decoding of event and instruction data, as column expressions.

256-bit integers have no Spark type. A word is read as four 64-bit limbs; the double is
a weighted sum of them and the exact value is a canonical decimal string, built by
carrying the limbs over base-10^18 digits (every intermediate fits DECIMAL(38,0)); values
of one or two limbs take a short cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = 10 ** 18
_DIGITS = 5  # 2^256 < 10^90


def _dec(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def word(data: Column, index: int) -> Column:
    """The ``index``-th 32-byte word of ``0x``-prefixed data, as 64 hex characters."""
    return F.substring(data, 3 + 64 * index, 64)


def address(word_or_topic: Column) -> Column:
    """Low 20 bytes of a word or topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(word_or_topic, F.lit(40))))


def is_negative(w: Column) -> Column:
    return F.substring(w, 1, 1).isin(*"89abcdefABCDEF")


def _magnitude(w: Column, signed: bool) -> tuple[Column, Column, Column]:
    """Hex of the magnitude, the +1 of the two's complement still to add, the sign flag."""
    if not signed:
        return w, F.lit(0), F.lit(False)
    neg = is_negative(w)
    flipped = F.translate(F.lower(w), "0123456789abcdef", "fedcba9876543210")
    return F.when(neg, flipped).otherwise(w), F.when(neg, 1).otherwise(0), neg


def _limb(m: Column, i: int) -> Column:
    """The ``i``-th unsigned 64-bit limb (0 is the lowest), as decimal text."""
    return F.conv(F.substring(m, 49 - 16 * i, 16), 16, 10)


def _fits(m: Column, limbs: int) -> Column:
    return F.substring(m, 1, 64 - 16 * limbs) == "0" * (64 - 16 * limbs)


def _as_double(w: Column, signed: bool) -> Column:
    m, plus, neg = _magnitude(w, signed)
    low = _limb(m, 0).cast("double") + plus
    wide = low
    for i in range(1, 4):
        wide = wide + _limb(m, i).cast("double") * F.lit(2.0 ** (64 * i))
    total = F.when(_fits(m, 1), low).otherwise(wide)
    return F.when(neg, -total).otherwise(total) if signed else total


def uint_double(w: Column) -> Column:
    return _as_double(w, False)


def int_double(w: Column) -> Column:
    return _as_double(w, True)


def _text_of(limbs: list[Column], plus: Column) -> Column:
    """Decimal text of four 64-bit limbs, the lowest first, plus a small number."""
    high = limbs[2] + limbs[3]
    # Below 5 * 10^18 * 2^64 two limbs fit DECIMAL(38,0): true for nearly all amounts.
    two = (limbs[1] * _dec(2 ** 64) + limbs[0] + plus).cast("decimal(38,0)").cast("string")
    one = (limbs[0] + plus).cast("decimal(38,0)").cast("string")
    # Otherwise: weighted limb sums per base-10^18 digit, then one carry pass over them.
    sums = []
    for d in range(_DIGITS):
        acc = plus.cast("decimal(38,0)") if d == 0 else _dec(0)
        for i, limb in enumerate(limbs):
            weight = (2 ** (64 * i)) // _BASE ** d % _BASE
            if weight:
                acc = acc + (limb * _dec(weight)).cast("decimal(38,0)")
        sums.append(acc.cast("decimal(38,0)"))

    def carry_on(state: Column, term: Column) -> Column:
        total = (term + state["carry"]).cast("decimal(38,0)")
        digit = (total % _dec(_BASE)).cast("decimal(38,0)")
        # The dividend is a multiple of the base, so the scaled product is exact.
        carry = ((total - digit) * F.lit("0.000000000000000001").cast("decimal(38,18)")).cast("decimal(38,0)")
        return F.struct(carry.alias("carry"), F.concat(
            F.lpad(digit.cast("string"), 18, "0"), state["text"]).alias("text"))

    start = F.struct(_dec(0).alias("carry"), F.lit("").alias("text"))
    long = F.regexp_replace(F.aggregate(F.array(*sums), start, carry_on)["text"], "^0+(?=[0-9])", "")
    return F.when((high == 0) & (limbs[1] == 0), one).when((high == 0) & (limbs[1] < _dec(5 * 10 ** 18)), two).otherwise(long)


def _as_string(w: Column, signed: bool) -> Column:
    m, plus, neg = _magnitude(w, signed)
    text = _text_of([_limb(m, i).cast("decimal(38,0)") for i in range(4)], plus)
    return F.when(neg & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text) if signed else text


def decoded(df: DataFrame, words: dict[str, tuple[str, str | None]], doubles: bool = True) -> DataFrame:
    """Adds ``<name>_text`` (exact) and ``<name>_raw`` (double) for words that are columns of ``df``.

    ``words`` maps a name to the column of its word and to that of its sign: null or 0 for a plain
    number, 1 for one to be negated, 2 for two's complement, -2 for two's complement to be negated.
    Magnitude, limbs and values are projections one above the other, so that each is worked out once.
    """
    first, limbs, last = {}, {}, {}
    for name, (w, sign) in words.items():
        kind = F.lit(0) if sign is None else F.coalesce(F.col(sign), F.lit(0))
        below = (F.abs(kind) == 2) & is_negative(F.col(w))
        flipped = F.translate(F.lower(F.col(w)), "0123456789abcdef", "fedcba9876543210")
        first[f"_{name}_m"] = F.when(below, flipped).otherwise(F.col(w))
        first[f"_{name}_p"] = F.when(below, 1).otherwise(0)
        first[f"_{name}_n"] = F.when(kind == 2, below).when(kind == -2, ~below).otherwise(kind == 1)
        limbs |= {f"_{name}_{i}": _limb(F.col(f"_{name}_m"), i).cast("decimal(38,0)") for i in range(4)}
    df = df.withColumns(first).withColumns(limbs)
    for name in words:
        own, plus = [F.col(f"_{name}_{i}") for i in range(4)], F.col(f"_{name}_p")
        last[f"_{name}_t"] = _text_of(own, plus)
        if doubles:
            total = own[0].cast("double") + plus
            for i in range(1, 4):
                total = total + own[i].cast("double") * F.lit(2.0 ** (64 * i))
            last[f"_{name}_d"] = total
    df = df.withColumns(last)
    out = {}
    for name in words:
        neg = F.col(f"_{name}_n")
        out[f"{name}_text"] = F.when(neg & (F.col(f"_{name}_t") != "0"), F.concat(F.lit("-"), F.col(f"_{name}_t"))).otherwise(F.col(f"_{name}_t"))
        if doubles:
            out[f"{name}_raw"] = F.when(neg & (F.col(f"_{name}_d") != 0), -F.col(f"_{name}_d")).otherwise(F.col(f"_{name}_d"))
    return df.withColumns(out).drop(*[f"_{n}_{c}" for n in words for c in (*"mpntd", *range(4))])


def uint_string(w: Column) -> Column:
    """Exact unsigned 256-bit value as a decimal string."""
    return _as_string(w, False)


def int_string(w: Column) -> Column:
    """Exact signed (two's complement) 256-bit value as a decimal string."""
    return _as_string(w, True)


def small_int(w: Column) -> Column:
    """Signed value of a word known to fit 64 bits (ticks, fees, spacings)."""
    return F.conv(F.substring(w, 49, 16), 16, -10).cast("long")


def discriminator(data_hex: Column, nbytes: int) -> Column:
    """First ``nbytes`` of instruction data given as hex without prefix."""
    return F.lower(F.substring(data_hex, 1, 2 * nbytes))


def u64_le(data_hex: Column, offset: int) -> Column:
    """Little-endian unsigned 64-bit integer at byte ``offset``, as DECIMAL(20,0)."""
    parts = [F.substring(data_hex, 1 + 2 * (offset + i), 2) for i in reversed(range(8))]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")


def u8(data_hex: Column, offset: int) -> Column:
    return F.conv(F.substring(data_hex, 1 + 2 * offset, 2), 16, 10).cast("int")


def abi_string(hex_text: Column) -> Column:
    """Text of an ABI-encoded string result: skip offset and length words, stop at NUL."""
    body = F.substring(F.regexp_replace(hex_text, "^0x", ""), F.lit(129), F.length(hex_text))
    text = F.decode(F.unhex(body), "ISO-8859-1")
    return F.coalesce(F.substring_index(text, "\u0000", 1), F.lit(""))


def sort_accounts(a: Column, b: Column) -> tuple[Column, Column]:
    """Two binary account keys in byte order."""
    return F.least(a, b), F.greatest(a, b)
