"""Grouping and the six aggregates: count, sum, avg, min, max, distinct.

Aggregates skip none.  Over nothing count and sum are 0, avg, min and max none,
distinct the empty set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import avg_of, distinct_of, sum_of
from ..functions.logic import true
from ..plans.view import StaticError, View
from .project import Output, Scope, _bound


class Group:
    """The member rows of a group: aggregates over them, or over those a condition selects."""

    def __init__(self, condition: Column | None = None):
        self.condition = condition

    def where(self, condition: Column) -> Group:
        return Group(true(condition) if self.condition is None else self.condition & true(condition))

    def _of(self, x: Column | str) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return x if self.condition is None else F.when(self.condition, x)

    def count(self) -> Column:
        return F.count(self._of(F.lit(1)))

    def sum(self, x: Column | str) -> Column:
        return sum_of(self._of(x))

    def avg(self, x: Column | str) -> Column:
        return avg_of(self._of(x))

    def min(self, x: Column | str) -> Column:
        return F.min(self._of(x))

    def max(self, x: Column | str) -> Column:
        return F.max(self._of(x))

    def distinct(self, x: Column | str) -> Column:
        return distinct_of(self._of(x))


def group(view: View, key: Mapping[str, Output], outputs: Mapping[str, Callable[[Group], Column]], sort=(), skip: int = 0, limit: int | None = None) -> View:
    """One row for each key value, by default in key order.

    Later key components may read earlier ones.  Outputs get the group; what is
    not aggregated must come from the key.
    """
    skip, limit = _bound("skip", skip) or 0, _bound("limit", limit)
    view = view.bounded()
    scope = Scope(view.fields, key)
    keyed = view.df.withColumns({f"__g_{k}": scope.output(k) for k in key})
    made = {name: out(Group()) for name, out in outputs.items() if name not in key}
    aggregates = [c.alias(name) for name, c in made.items()]
    by = [F.col(f"__g_{k}").alias(k) for k in key]
    df = keyed.groupBy(*by).agg(*aggregates) if aggregates else keyed.select(*by).distinct()
    df = df.withColumns({f"__id{i}": F.col(k) for i, k in enumerate(key)})
    down = ()
    if sort:
        after = Scope(df.columns, {})
        df = df.withColumns({f"__ord{i}": after[k] if isinstance(k, str) else k for i, (k, _) in enumerate(sort)})
        down = tuple(bool(d) for _, d in sort)
    if unknown := [k for k, _ in sort if isinstance(k, str) and k not in df.columns]:
        raise StaticError(f"unknown sort key {unknown}")
    return View(df, len(key), down, f"{view.relation}/group({','.join(key)})", skip=skip, limit=limit)


def aggregate(view: View, **outputs: Callable[[Group], Column]) -> DataFrame:
    """A one-row frame of aggregates over a whole view."""
    return view.bounded().df.agg(*[out(Group()).alias(name) for name, out in outputs.items()])


def correlated(view: View, other: View, on: Mapping[str, str], **outputs: Callable[[Group], Column]) -> View:
    """Aggregates over the rows of ``other`` that belong to each row; rows without any get the empty results.

    ``other`` is aggregated before it is joined, so what moves is a row a key.
    """
    view, other = view.bounded(), other.bounded()
    keys = [F.col(c).alias(f"__c{i}") for i, c in enumerate(on.values())]
    made = {name: out(Group()) for name, out in outputs.items()}
    some = other.df.groupBy(*keys).agg(*[c.alias(n) for n, c in made.items()])
    none = other.df.where(F.lit(False)).agg(*[c.alias(n) for n, c in made.items()]).first()
    match = [F.col(v).eqNullSafe(F.col(f"__c{i}")) for i, v in enumerate(on)]
    df = view.df.join(some, match, "left").drop(*[f"__c{i}" for i in range(len(on))])
    fill = {n: F.coalesce(F.col(n), F.lit(none[n]).cast(some.schema[n].dataType)) for n in made if none[n] is not None and none[n] != []}
    fill |= {n: F.coalesce(F.col(n), F.array().cast(some.schema[n].dataType)) for n in made if none[n] == []}
    return view.on(df.withColumns(fill) if fill else df)
