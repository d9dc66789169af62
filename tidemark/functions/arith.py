"""Numbers: exact integers and decimals.

Division of integers truncates and the remainder takes the dividend's sign.
Division of decimals keeps 16 digits after the point.  Anything beyond 38
digits is an error, never a wrong number; so is division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point that division of decimals keeps.
DIVISION_SCALE = 16
ROUNDINGS = ("half_up", "half_even", "floor", "ceiling", "toward_zero", "away_from_zero")


def decimal(x: Column, precision: int = 18, scale: int = 2) -> Column:
    return x.cast(f"decimal({precision},{scale})")


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def rem(a: Column, b: Column) -> Column:
    return a % b


#: The type that decimals are computed in.
EXACT = "decimal(38,16)"
#: Digits after the point of both factors, so that a product has 16 at most.
_FACTORS = ((5, 5), (8, 8), (0, 16), (16, 0), (10, 6), (6, 10), (12, 4), (4, 12), (14, 2), (2, 14))


def _refused(what: str) -> Column:
    return F.raise_error(F.lit(f"{what} beyond 38 digits")).cast(EXACT)


def _first(choices: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for fits, then in choices:
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out.otherwise(otherwise)


def term(x: Column) -> Column:
    """An operand of a sum or remainder that Spark works out without rounding."""
    return x.cast("decimal(37,16)")


def product(a: Column, b: Column) -> Column:
    """a * b, every digit of it, or an error."""
    a, b = a.cast(EXACT), b.cast(EXACT)
    cut = lambda x, precision, scale: x.try_cast(f"decimal({precision},{scale})")
    choices = [((cut(a, 19, s) == a) & (cut(b, 18, t) == b), (cut(a, 19, s) * cut(b, 18, t)).cast(EXACT)) for s, t in _FACTORS]
    return F.when(a.isNotNull() & b.isNotNull(), _first(choices, _refused("a product")))


def quotient(a: Column, b: Column, mode: str = "half_up") -> Column:
    """a / b at 16 digits after the point, rounded once from the exact quotient.

    Both are whole numbers of their last digit's unit; the whole part and the
    16 digits come from two integer divisions, and what is left over decides
    how to round.
    """
    if mode not in ROUNDINGS:
        raise ValueError(f"no rounding mode {mode}")
    a, b = a.cast(EXACT), b.cast(EXACT)
    scales = (4, 8, 12, 16, 0)
    both = {s: (a.try_cast(f"decimal(22,{s})") == a) & (b.try_cast(f"decimal(22,{s})") == b) for s in scales}
    unit = lambda x, s: (F.abs(x.try_cast(f"decimal(22,{s})")) * F.lit(10**s).cast(f"decimal({s + 1},0)")).cast("decimal(22,0)")
    p, q = (_first([(both[s], unit(x, s)) for s in scales], _refused("a quotient").cast("decimal(22,0)")) for x in (a, b))
    whole = ((p - p % q).cast("decimal(22,0)") / q).cast("decimal(22,0)")
    shifted = (p % q).cast("decimal(21,0)") * F.lit(10**DIVISION_SCALE).cast("decimal(17,0)")
    digits = F.call_function("div", shifted, q)
    left, negative = shifted % q, (a < 0) != (b < 0)
    # half of the divisor without leaving whole numbers
    half = (left.cast("decimal(23,0)") * F.lit(2).cast("decimal(1,0)")).cast("decimal(24,0)")
    up = {
        "half_up": half >= q,
        "half_even": (half > q) | ((half == q) & (digits % 2 == 1)),
        "floor": negative & (left > 0),
        "ceiling": ~negative & (left > 0),
        "toward_zero": F.lit(False),
        "away_from_zero": left > 0,
    }[mode]
    part = (digits + F.when(up, 1).otherwise(0)).cast("decimal(17,0)") * F.lit("0.0000000000000001").cast("decimal(16,16)")
    size = (whole.cast("decimal(21,0)") + part.cast("decimal(17,16)")).cast(EXACT)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(negative, -size).otherwise(size))


def decimal_div(a: Column, b: Column) -> Column:
    """a / b for a up to DECIMAL(18,2) and a whole b, half away from zero at scale 16."""
    return a.cast("decimal(18,2)") / b.cast("decimal(13,0)")


def rounded(x: Column, scale: int, mode: str = "half_up") -> Column:
    """A decimal at fewer digits after the point, in one of six modes."""
    if mode == "half_up":
        return F.round(x, scale)
    if mode == "half_even":
        return F.bround(x, scale)
    down, up = F.floor(x, F.lit(scale)), F.ceil(x, F.lit(scale))
    if mode == "floor":
        return down
    if mode == "ceiling":
        return up
    if mode == "toward_zero":
        return F.when(x < 0, up).otherwise(down)
    if mode == "away_from_zero":
        return F.when(x < 0, down).otherwise(up)
    raise ValueError(f"no rounding mode {mode}")


def decimal_text(x: Column) -> Column:
    """Canonical text: no zeros after the last digit that counts, no point without digits."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(F.when(F.contains(text, F.lit(".")), plain).otherwise(text))


def sum_of(x: Column) -> Column:
    """0 for no values."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_of(x: Column, mode: str = "half_up") -> Column:
    """Exact division of the sum by the count at 16 digits; none for no values."""
    n = F.count(x)
    return F.when(n > 0, quotient(F.sum(x), F.when(n > 0, n), mode))


def distinct_of(x: Column) -> Column:
    """The set of values, in order."""
    return F.array_sort(F.collect_set(x))
