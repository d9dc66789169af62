"""Set operators by identity.

Repeated rows of the left side survive; only the right side is reduced
against it.  All operands must be of one identity domain.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.order import asc, positioned
from ..plans.view import StaticError, View


def _same(a: View, b: View) -> tuple[View, View]:
    if a.relation != b.relation or a.ids != b.ids:
        raise StaticError(f"views of {a.relation} and {b.relation} have no identity in common")
    return a.bounded(), b.bounded()


def _by_identity(a: View, b: View, how: str):
    right = b.df.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(b.id_columns)])
    on = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(a.id_columns)]
    return a.df.join(right, on, how)


def concatenated(a: View, b: View) -> View:
    """The left's rows, then the right's."""
    a, b = a.bounded(), b.bounded()
    if set(a.fields) != set(b.fields):
        raise StaticError("combined views must have the same fields")
    width = max(len(a.down), len(b.down))
    if a.down != b.down:
        # different orders meet as positions of their own
        a, b = (v.on(positioned(v.df, v.order(), "__place").drop(*[f"__ord{i}" for i in range(width)]).withColumnRenamed("__place", "__ord0"), down=(False,)) for v in (a, b))
    frames = []
    for side, v in enumerate((a, b)):
        shifted = {f"__ord{i + 1}": F.col(f"__ord{i}") for i in range(len(v.down))}
        df = v.df.withColumns(shifted).withColumn("__ord0", F.lit(side))
        frames.append(df.select(*a.fields, *v.id_columns, *[f"__ord{i}" for i in range(len(v.down) + 1)]))
    return a.on(frames[0].unionByName(frames[1]), down=(False, *a.down))


def union(a: View, b: View) -> View:
    """The left's rows in order, then the right's rows of new identities, each once: its first in the right's order."""
    a, b = _same(a, b)
    new = b.on(_by_identity(b, a, "left_anti"))
    first = Window.partitionBy(*new.id_columns).orderBy(*new.order())
    new = new.on(new.df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))
    return concatenated(a, new)


def intersection(a: View, b: View) -> View:
    """The left's rows whose identity the right has."""
    a, b = _same(a, b)
    return a.on(_by_identity(a, b, "left_semi"))


def difference(a: View, b: View) -> View:
    """The left's rows whose identity the right lacks."""
    a, b = _same(a, b)
    return a.on(_by_identity(a, b, "left_anti"))


def fallback(a: View, b: View) -> View:
    """``a ?? b``: the left if it has rows, else the right.

    Whether the left is empty is one row, joined to the right on a constant.
    """
    a, b = a.bounded(), b.bounded()
    flag = a.df.limit(1).agg(F.count(F.lit(1)).alias("__some"))
    rest = b.df.join(F.broadcast(flag), F.col("__some") == 0).drop("__some")
    return concatenated(a, b.on(rest))


def merge_occurrences(view: View) -> View:
    """Adds the number of a row among the rows of its identity, so that repeats stay apart."""
    order = Window.partitionBy(*view.id_columns).orderBy(*view.order(), *[asc(f) for f in view.fields])
    return view.on(view.df.withColumn("__occurrence", F.row_number().over(order)))
