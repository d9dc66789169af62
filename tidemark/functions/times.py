"""Instants, durations and replayable identities."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"(-)?P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$")
#: Microseconds of the units that a duration may have, weeks to seconds.
_UNITS = (604_800_000_000, 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000)


def duration(text: str) -> int:
    """Microseconds of an ISO-8601 duration of weeks, days, hours, minutes and seconds."""
    m = _DURATION.match(text)
    if not m or not any(m.groups()[1:]) or text.endswith("T"):
        raise ValueError(f"not a duration: {text}")
    micros = sum(int(v) * u for v, u in zip(m.groups()[1:6], _UNITS, strict=True) if v)
    part = Decimal(f"0.{m[7] or 0}") * 1_000_000
    if part != int(part):
        raise ValueError(f"finer than microseconds: {text}")
    return (-1 if m[1] else 1) * (micros + int(part))


def shifted(instant: Column, micros: Column | int) -> Column:
    """The instant a duration later, or earlier for a negative one."""
    micros = F.lit(micros) if isinstance(micros, int) else micros
    return F.timestamp_micros(F.unix_micros(instant) + micros)


def rescaled(count: Column, digits_from: int, digits_to: int) -> Column:
    """A count of 10**-from seconds as one of 10**-to; coarser ones are rounded half away from zero."""
    if digits_to >= digits_from:
        return count * F.lit(10 ** (digits_to - digits_from))
    step = F.lit(10 ** (digits_from - digits_to))
    half = F.when(count < 0, -(step / 2)).otherwise(step / 2).cast("long")
    return F.call_function("div", count + half, step)


def seeded_uuid(seed: str, *parts: Column) -> Column:
    """An identity that a replay gives again: a version-4-shaped hash of the seed and the parts."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts]), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    pick = F.substr(variant, (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(pick, F.substring(h, 18, 3)), F.substring(h, 21, 12))
