"""Joins by traversal, reference, correlation and membership.

Joins state only their condition.  Catalyst takes out the equal parts, AQE
broadcasts a side that turns out small and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.view import View


def _side(view: View, tag: str, prefix: str) -> DataFrame:
    """Fields with a prefix, hidden columns with a tag."""
    return view.df.select(*[F.col(c).alias(f"{tag}{c}" if c.startswith("__") else f"{prefix}{c}") for c in view.df.columns])


def _composed(left: View, right: View, df: DataFrame, relation: str) -> View:
    """Identity and order of a pair: the left's, then the right's."""
    names, ids = [], left.ids + right.ids
    names += [F.col(f"__l__id{i}").alias(f"__id{i}") for i in range(left.ids)]
    names += [F.col(f"__r__id{i}").alias(f"__id{left.ids + i}") for i in range(right.ids)]
    order, down = [], []
    if left.down or right.down:
        for view, tag in ((left, "__l"), (right, "__r")):
            cols = [(f"{tag}__ord{i}", d) for i, d in enumerate(view.down)] + [(f"{tag}__id{i}", False) for i in range(view.ids)]
            for c, d in cols:
                order.append(F.col(c).alias(f"__ord{len(order)}"))
                down.append(d)
    fields = [F.col(c) for c in df.columns if not c.startswith("__")]
    return View(df.select(*fields, *names, *order), ids, tuple(down), relation)


def correlate(left: View, right: View, condition: Column, prefix: str = "") -> View:
    """Pairs of rows for which the condition holds; the right's fields get the prefix.

    The condition names the left's fields as they are and the right's with the
    prefix.
    """
    left, right = left.bounded(), right.bounded()
    df = _side(left, "__l", "").join(_side(right, "__r", prefix), condition)
    return _composed(left, right, df, f"{left.relation}*{right.relation}")


def traverse(parent: View, child: View, on: Mapping[str, str], prefix: str = "child_") -> View:
    """``parent::child``: every child row with its parent's fields.

    ``on`` maps the parent's fields to the child's.  The identity is the
    parent's followed by the child's.
    """
    condition = None
    for p, c in on.items():
        eq = F.col(p) == F.col(f"{prefix}{c}")
        condition = eq if condition is None else condition & eq
    return correlate(parent, child, condition, prefix)


def dereference(view: View, ref: str, target: View, prefix: str = "ref_") -> View:
    """``/target[.ref]``: the row that a reference names, N:1, rows without one drop out; the identity stays the view's."""
    view, target = view.bounded(), target.bounded()
    right = target.df.select(*[F.col(c).alias(f"{prefix}{c}") for c in target.fields], F.col("__id0").alias("__t"))
    return view.on(view.df.join(right, F.col(ref) == F.col("__t")).drop("__t"))


def dereference_field(view: View, ref: str, target: View, field: str, name: str) -> View:
    """``/target[.ref].field`` as a scalar: none where the reference is none, an error where it names no row."""
    view, target = view.bounded(), target.bounded()
    right = target.df.select(F.col("__id0").alias("__t"), F.col(field).alias(name))
    df = view.df.join(right, F.col(ref) == F.col("__t"), "left")
    found = F.when(F.col(ref).isNull() | F.col("__t").isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit("expected exactly one row")).cast(target.df.schema[field].dataType))
    return view.on(df.withColumn(name, found).drop("__t"))


def dereference_set(view: View, refs: str, target: View, prefix: str = "ref_") -> View:
    """``/target[.refs]`` for a set of references: one row for each element, in the set's order."""
    view, target = view.bounded(), target.bounded()
    ordered = F.array_sort(F.array_distinct(F.col(refs)))
    df = view.df.select("*", F.posexplode(ordered).alias("__at", "__ref"))
    right = target.df.select(*[F.col(c).alias(f"{prefix}{c}") for c in target.fields], F.col("__id0").alias("__t"))
    df = df.join(right, F.col("__ref") == F.col("__t")).withColumn(f"__id{view.ids}", F.col("__ref")).drop("__t", "__ref")
    keys = [f"__ord{i}" for i in range(len(view.down))] + (view.id_columns if view.down else [])
    if view.down:
        df = df.withColumns({f"__ord{len(view.down) + i}": F.col(c) for i, c in enumerate(view.id_columns)}).withColumn(f"__ord{len(keys)}", F.col("__at"))
        down = (*view.down, *[False] * (view.ids + 1))
    else:
        down = ()
    return View(df.drop("__at"), view.ids + 1, down, f"{view.relation}*{target.relation}")


def active_at(left: View, right: View, condition: Column, instant: Column, start: str, end: str, prefix: str = "") -> View:
    """As-of join: rows of ``right`` whose interval [start, end) holds the left's instant, none as an end meaning for ever."""
    held = (F.col(f"{prefix}{start}") <= instant) & (F.col(f"{prefix}{end}").isNull() | (instant < F.col(f"{prefix}{end}")))
    return correlate(left, right, condition & held, prefix)
