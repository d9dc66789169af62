"""Comparison and logic.

None is a value: it equals itself and is greater than everything else.
Comparisons and logic therefore never give null, and a filter keeps a row if
and only if its condition is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def true(x: Column) -> Column:
    """Whether x is true; none counts as false."""
    return F.coalesce(x, F.lit(False))


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def gt(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNotNull()) | true(a > b)


def lt(a: Column, b: Column) -> Column:
    return gt(b, a)


def ge(a: Column, b: Column) -> Column:
    return a.isNull() | true(a >= b)


def le(a: Column, b: Column) -> Column:
    return ge(b, a)


def all_of(*xs: Column) -> Column:
    """And, from left to right: a later operand is not evaluated where an earlier one is not true."""
    return reduce(lambda rest, x: F.when(true(x), rest).otherwise(F.lit(False)), reversed(xs[:-1]), true(xs[-1]))


def any_of(*xs: Column) -> Column:
    return reduce(lambda rest, x: F.when(true(x), F.lit(True)).otherwise(rest), reversed(xs[:-1]), true(xs[-1]))


def negated(x: Column) -> Column:
    return ~true(x)


def has(x: Column) -> Column:
    return x.isNotNull()


def in_set(x: Column, elements: Column) -> Column:
    return true(F.array_contains(elements, x))


def asserted(condition: Column, message: str) -> Column:
    """True, or an error with the message."""
    return F.when(true(condition), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
