"""Bounded windows over an ordered view: the first, the last, or around an anchor."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.view import View


def first(view: View, n: int) -> DataFrame:
    """The first n rows with positions: a top-k, no full sort."""
    from dataclasses import replace

    view = view.bounded()
    return replace(view, limit=n).positions()


def last(view: View, n: int) -> DataFrame:
    """The last n rows, at their positions in the whole view."""
    count = view.rows().count()
    return view.positions().where(F.col("pos") > count - n)


def _position(view: View, anchor: Mapping) -> tuple[int | None, int, int]:
    """The anchor's position, how many rows come before it, and the count of rows.

    An anchor that has left the view keeps its place by its sort keys and
    identity, which ``anchor`` still holds.
    """
    view = view.bounded()
    keys = [f"__ord{i}" for i in range(len(view.down))] + view.id_columns
    down = [*view.down, *[False] * view.ids]
    before, same = F.lit(False), F.lit(True)
    for k, d in zip(keys, down, strict=True):
        kind = view.df.schema[k].dataType
        x, a = F.col(k), F.lit(anchor[k]).cast(kind)
        # none is the greatest value
        smaller = (x.isNotNull() & a.isNull()) | F.coalesce(x < a, F.lit(False))
        greater = (x.isNull() & a.isNotNull()) | F.coalesce(x > a, F.lit(False))
        before = before | (same & (greater if d else smaller))
        same = same & x.eqNullSafe(a)
    row = view.df.agg(F.count_if(before).alias("before"), F.count_if(same).alias("here"), F.count(F.lit(1)).alias("n")).first()
    return (row["before"] + 1 if row["here"] else None), row["before"], row["n"]


def anchored(view: View, anchor: Mapping, n: int) -> DataFrame:
    """n rows from the anchor on; where the anchor has left, from the first row after its place."""
    _, before, _ = _position(view, anchor)
    return view.positions().where(F.col("pos").between(before + 1, before + n))


def centred(view: View, anchor: Mapping, n: int) -> DataFrame:
    """n rows around the anchor, shifted inwards at either end."""
    _, before, count = _position(view, anchor)
    start = min(max(before - n // 2, 0), max(count - n, 0))
    return view.positions().where(F.col("pos").between(start + 1, start + n))
