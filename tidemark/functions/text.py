"""Text, bytes and their codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = r"\p{IsWhite_Space}"


def lower(x: Column) -> Column:
    return F.lower(x)


def upper(x: Column) -> Column:
    return F.upper(x)


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def casefold(x: Column) -> Column:
    """Full case folding, which no built-in function does; ASCII text never leaves the JVM's columns for it in vain."""
    return _casefold(x)


def trim(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def size(x: Column) -> Column:
    """Code points of a text."""
    return F.char_length(x).cast("long")


def base64_encode(x: Column) -> Column:
    return F.regexp_replace(F.base64(x), r"\s", "")


def base64_decode(x: Column) -> Column:
    """Bytes; an error unless the text is what encoding them gives."""
    raw = F.unbase64(x)
    return F.when(x.isNull() | (base64_encode(raw) == x), raw).otherwise(F.raise_error(F.lit("not canonical base64")).cast("binary"))


def hex_encode(x: Column) -> Column:
    return F.lower(F.hex(x))


def hex_decode(x: Column) -> Column:
    """Bytes of hex digits in either case; an error for anything else."""
    good = x.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(x.isNull() | good, F.unhex(x)).otherwise(F.raise_error(F.lit("not hex")).cast("binary"))


def utf8_bytes(x: Column) -> Column:
    return F.encode(x, "UTF-8")


def utf8_text(x: Column) -> Column:
    """Text of UTF-8 bytes; an error where they are none."""
    return F.validate_utf8(x.cast("string"))


def digest(x: Column, bits: int = 256) -> Column:
    return F.sha2(x, bits)


def key_text(*parts: Column) -> Column:
    """The canonical text of a key: ``%``, ``/`` and ``:`` escaped within a part, parts joined by ``:``."""
    out = []
    for p in parts:
        p = p.cast("string")
        for mark, code in (("%", "%25"), ("/", "%2F"), (":", "%3A")):
            p = F.replace(p, F.lit(mark), F.lit(code))
        out.append(p)
    return F.concat_ws(":", *out)
