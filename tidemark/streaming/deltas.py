"""Deltas: what turns one delivered state of a view into the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.view import View

PATCHES = ("insert", "remove", "move", "update", "rekey")


def changed(before: View, after: View) -> DataFrame:
    """(op, id..., row): inserted, removed and updated rows by identity, without positions."""
    fields = [f for f in after.fields]
    b, a = before.bounded(), after.bounded()
    ids = a.id_columns
    left = b.df.select(*ids, F.struct(*fields).alias("__old"), F.lit(True).alias("__b"))
    right = a.df.select(*ids, F.struct(*fields).alias("__new"), F.lit(True).alias("__a"))
    both = left.join(right, ids, "full")
    op = F.when(F.col("__b").isNull(), "insert").when(F.col("__a").isNull(), "remove").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", *[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)], F.coalesce("__new", "__old").alias("row"))


def patch(before: list[tuple], after: list[tuple]) -> list[tuple]:
    """Ordered patch of two delivered windows, lists of (id, row): applied in turn, it makes the one the other.

    Windows are bounded, so this runs on the driver.  Rows that stay in order
    are not moved: they are a longest increasing run of old positions.
    """
    from bisect import bisect_left

    old = {i: p for p, (i, _) in enumerate(before)}
    rows = dict(before)
    out = [("remove", i, None, None) for i, _ in before if i not in dict(after)]
    stay = [i for i, _ in after if i in old]
    tails, links, at = [], {}, []
    for i in stay:
        k = bisect_left(at, old[i])
        links[i] = tails[k - 1] if k else None
        if k == len(tails):
            tails.append(i)
            at.append(old[i])
        else:
            tails[k], at[k] = i, old[i]
    still, i = set(), tails[-1] if tails else None
    while i is not None:
        still.add(i)
        i = links[i]
    for p, (i, row) in enumerate(after):
        if i not in old:
            out.append(("insert", i, p, row))
            continue
        if i not in still:
            out.append(("move", i, p, None))
        if rows[i] != row:
            out.append(("update", i, p, row))
    return out


def applied(window: list[tuple], patches: list[tuple]) -> list[tuple]:
    """A client's side of ``patch``."""
    now = [i for i, _ in window]
    rows = dict(window)
    gone = {i for op, i, _, _ in patches if op in ("remove", "move")}
    moved = [i for op, i, _, _ in patches if op == "move"]
    now = [i for i in now if i not in gone]
    for op, i, p, row in patches:
        if op in ("insert", "move"):
            now.insert(p, i)
        if op in ("insert", "update"):
            rows[i] = row
    assert all(i in now for i in moved)
    return [(i, rows[i]) for i in now]
