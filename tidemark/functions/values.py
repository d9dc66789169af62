"""Values that need a key to be ordered, or a strict reading: JSON and enums.

A JSON value's order key is a byte string without prefixes of one another, so
that the order of bytes is the order null < bool < number < string < array <
object, arrays by elements and objects by sorted members.
"""

from __future__ import annotations

import json
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def _number_key(x: Decimal) -> bytes:
    """Sign, exponent and digits; negative numbers with all bits turned."""
    if x == 0:
        return b"\x01"
    sign, digits, exponent = x.normalize().as_tuple()
    body = struct.pack(">i", len(digits) + exponent + (1 << 30)) + bytes(d + 1 for d in digits) + b"\x00"
    return b"\x00" + bytes(255 - b for b in body) if sign else b"\x02" + body


def _text_key(s: str) -> bytes:
    return s.encode().replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def json_bytes(value) -> bytes:
    if value is None:
        return b"\x01"
    if isinstance(value, bool):
        return b"\x02" + bytes([value])
    if isinstance(value, int | Decimal):
        return b"\x03" + _number_key(Decimal(value))
    if isinstance(value, str):
        return b"\x04" + _text_key(value)
    if isinstance(value, list):
        return b"\x05" + b"".join(map(json_bytes, value)) + b"\x00"
    return b"\x06" + b"".join(b"\x01" + _text_key(k) + json_bytes(value[k]) for k in sorted(value)) + b"\x00"


@F.pandas_udf(BinaryType())
def _json_key(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else json_bytes(json.loads(t, parse_float=Decimal)))


def json_key(text: Column) -> Column:
    """Order key of JSON text; Spark orders neither maps nor variants."""
    return _json_key(text)


def _plain(x):
    if isinstance(x, Decimal):
        x = x.normalize()
        return int(x) if x == x.to_integral_value() else float(x) if Decimal(repr(float(x))) == x else x
    if isinstance(x, list):
        return [_plain(y) for y in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


@F.pandas_udf(StringType())
def _json_text(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else json.dumps(_plain(json.loads(t, parse_float=Decimal)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def json_text(text: Column) -> Column:
    """Canonical JSON: members by name, numbers at their shortest, no spaces."""
    return _json_text(text)


def enum_label(text: Column, labels: list[str]) -> Column:
    """The label, or an error if it is not declared."""
    return F.when(text.isNull() | text.isin(labels), text).otherwise(F.raise_error(F.concat(F.lit("unknown label "), text)).cast("string"))


def set_of(*elements: Column) -> Column:
    """A set literal: distinct elements in order, none left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*elements))))


def set_add(elements: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(elements, more))


def set_remove(elements: Column, less: Column) -> Column:
    return F.array_sort(F.array_except(elements, less))
