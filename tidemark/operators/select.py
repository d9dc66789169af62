"""Selectors: conditions, keys, membership."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.view import StaticError, View


def where(view: View, *conditions: Column | Callable[[DataFrame], Column]) -> View:
    """Rows for which all conditions are true; none is not.

    A filter drops none by itself, so conditions stay bare and reach the scan.
    """
    view = view.bounded()
    df = view.df
    for x in conditions:
        df = df.where(x if isinstance(x, Column) else x(view.df))
    return view.on(df)


def empty(view: View) -> View:
    return view.on(view.df.where(F.lit(False)), unbounded=False)


def by_keys(view: View, keys: Iterable) -> View:
    """The rows with the keys, in the keys' order, a repeated key repeating its row.

    A join keeps order and repeats, which ``isin`` loses.  A composite key is a
    tuple in key order.  Few literal keys are a local table, broadcast by its
    size; the collection's side never moves.
    """
    view = view.bounded()
    keys = [k if isinstance(k, tuple) else (k,) for k in keys]
    if any(len(k) != view.ids for k in keys):
        raise StaticError("a key must have exactly the key's components")
    types = [view.df.schema[c].dataType.simpleString() for c in view.id_columns]
    schema = ", ".join(f"__k{i} {t}" for i, t in enumerate(types))
    wanted = view.df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{schema}, __at int")
    return _joined(view, wanted)


def by_set(view: View, elements: DataFrame, column: str) -> View:
    """The rows with the keys in a set column of a one-row frame, in the set's canonical order."""
    view = view.bounded()
    ordered = F.array_sort(F.array_distinct(F.col(column)))
    return _joined(view, elements.select(F.posexplode(ordered).alias("__at", "__k0")))


def _joined(view: View, wanted: DataFrame) -> View:
    on = [view.df[c].eqNullSafe(wanted[f"__k{i}"]) for i, c in enumerate(view.id_columns)]
    old = [c for c in view.df.columns if c.startswith("__ord")]
    df = view.df.join(wanted, on).withColumn("__place", F.col("__at")).drop(*old, *wanted.columns)
    return view.on(df.withColumnRenamed("__place", "__ord0"), down=(False,))


def among(view: View, other: View, columns: Iterable[str] | None = None) -> View:
    """Rows whose columns (the identity by default) are the identity of a row of ``other``."""
    return _membership(view, other, columns, "left_semi")


def not_among(view: View, other: View, columns: Iterable[str] | None = None) -> View:
    """The other rows; none is in no view.  An anti join, not NOT IN, which a null would empty."""
    return _membership(view, other, columns, "left_anti")


def _membership(view: View, other: View, columns, how: str) -> View:
    view, other = view.bounded(), other.bounded()
    columns = list(columns or view.id_columns)
    right = other.df.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(other.id_columns)])
    on = [F.col(c) == F.col(f"__m{i}") for i, c in enumerate(columns)]
    return view.on(view.df.join(right, on, how))


def exactly_one(view: View) -> View:
    """The view's row; an error unless it has exactly one."""
    if len(view.bounded().df.limit(2).collect()) != 1:
        raise ValueError("expected exactly one row")
    return view


def non_empty(view: View) -> bool:
    return not view.bounded().df.isEmpty()


def non_empty_flag(view: View, name: str = "has") -> DataFrame:
    """One row that says whether the view has any."""
    return view.bounded().df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
