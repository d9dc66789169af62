"""Projection: outputs that may read one another, nested outputs, order and bounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.view import StaticError, View

Output = Column | Callable[["Scope"], Column]


class Scope:
    """Names of a projection: the row's own first, then outputs, worked out as they are asked for."""

    def __init__(self, columns, outputs: Mapping[str, Output]):
        self.columns, self.outputs, self.open = set(columns), outputs, []

    def __getitem__(self, name: str) -> Column:
        if name in self.columns:
            return F.col(name)
        return self.output(name)

    def output(self, name: str) -> Column:
        if name not in self.outputs:
            raise StaticError(f"unknown name {name}")
        if name in self.open:
            raise StaticError(f"outputs read each other in a circle: {' -> '.join([*self.open, name])}")
        self.open.append(name)
        out = self.outputs[name]
        out = out if isinstance(out, Column) else out(self)
        self.open.pop()
        return out


def _bound(name: str, n) -> int | None:
    if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
        raise StaticError(f"${name} takes an integer from 0 on")
    return n


def project(view: View, outputs: Mapping[str, Output], sort=(), skip: int = 0, limit: int | None = None, quantity: Output | None = None) -> View:
    """The outputs of each row.

    ``sort`` lists (key, descends) and sees the row and the outputs; without it
    the source's order stays.  Skip and limit count after sorting.
    """
    skip, limit = _bound("skip", skip) or 0, _bound("limit", limit)
    view = view.bounded()
    scope = Scope(view.fields, outputs)
    columns = [scope.output(name).alias(name) for name in outputs]
    hidden = [F.col(c) for c in view.df.columns if c.startswith("__")]
    down = view.down
    if sort:
        hidden = [F.col(c) for c in view.df.columns if c.startswith("__") and not c.startswith("__ord")]
        for i, (key, _) in enumerate(sort):
            key = scope[key] if isinstance(key, str) else key if isinstance(key, Column) else key(scope)
            hidden.append(key.alias(f"__ord{i}"))
        down = tuple(bool(d) for _, d in sort)
    if quantity is not None:
        q = quantity if isinstance(quantity, Column) else quantity(scope)
        hidden += [q.cast("decimal(38,6)").alias("__quantity")]
    return view.on(view.df.select(*columns, *hidden), down=down, skip=skip, limit=limit)


def sort(view: View, *keys: tuple[str | Column, bool], skip: int = 0, limit: int | None = None) -> View:
    """The same fields in another order."""
    return project(view, {f: F.col(f) for f in view.fields}, keys, skip, limit)


def computed(view: View, fields: Mapping[str, Output]) -> View:
    """The view with further, read-only fields; they may read one another."""
    scope = Scope(view.fields, fields)
    return view.on(view.df.withColumns({name: scope.output(name) for name in fields}))


def choose(condition: Column, then: View, other: View) -> View:
    """``condition ? then : other`` for views: the condition is a one-row scalar, or free of rows.

    Both sides are read, of which Spark prunes one when the condition is a
    constant.
    """
    from .combine import concatenated

    then, other = then.bounded(), other.bounded()
    return concatenated(then.on(then.df.where(condition)), other.on(other.df.where(~condition)))


def nested(parent: View, child: View, on: Mapping[str, str], name: str, fields: list[str] | None = None) -> View:
    """The parent with an array of its child rows, in the child's order; an empty array for none.

    ``on`` maps the parent's columns to the child's.  The child is aggregated by
    the join keys first, so one shuffle of either side is enough.
    """
    child = child.bounded()
    fields = fields or child.fields
    # sort keys that put none last, then the identity
    keys = [F.col(f"__ord{i}") for i in range(len(child.down))] + [F.col(c) for c in child.id_columns]
    flags = [*child.down, *[False] * child.ids]
    if any(flags):
        raise StaticError("a nested collection is ordered by ascending keys")
    sortable = [x for k in keys for x in (k.isNull(), k)]
    item = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sortable)], F.struct(*fields).alias("row"))
    grouped = child.df.groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(on.values())]).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))
    parent = parent.bounded()
    match = [F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(on)]
    df = parent.df.join(grouped, match, "left").drop(*[f"__p{i}" for i in range(len(on))])
    row = df.schema[name].dataType.simpleString()
    return parent.on(df.withColumn(name, F.coalesce(name, F.array().cast(row))))
