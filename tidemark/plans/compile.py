"""From the language's trees to DataFrames: names, types and joins are settled here, the rest is Catalyst's.

A view expression becomes a ``Rel``: a frame whose columns have names of their
own, so that any two can be joined, with bindings that say which columns a
name's fields are.  Conditions that read the row outside stay apart and become
the join condition where the view is used: an inner join for views, a grouped
left join for aggregates, a left join for a single row's field.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arith, logic, text, times
from ..functions.arith import avg_of, distinct_of, sum_of
from ..functions.host import HostError, Registry
from ..functions.order import asc, desc
from .language import Node
from .model import SCALARS, Field, Model, Shape
from .view import StaticError

_names = itertools.count()
AGGREGATES = ("count", "sum", "avg", "min", "max", "distinct")
NUMBERS = ("int", "decimal")


def fresh(name: str) -> str:
    return f"c{next(_names)}_{name}"


@dataclass(frozen=True)
class Val:
    """A scalar: its column, kind, whether it may be none, and members of a struct or element of a set."""

    col: Column
    kind: str
    optional: bool = False
    decl: Field | None = None


@dataclass
class Row:
    """What a binding's name gives: fields as columns, the declaration behind them, the identity."""

    columns: dict[str, Val]
    shape: Shape | None = None
    ids: list[str] = field(default_factory=list)
    structural: dict[str, Val] = field(default_factory=dict)


@dataclass
class Rel:
    df: DataFrame
    cur: Row
    ids: list[str]
    relation: str
    rows: dict[str, Row] = field(default_factory=dict)
    order: list[tuple[str, bool]] = field(default_factory=list)
    #: Conditions that read the row outside.
    outside: list[Column] = field(default_factory=list)
    outs: list[tuple[str, str]] | None = None
    skip: int = 0
    limit: int | None = None
    unbounded: bool = False
    temporal: bool = False
    #: The single root row, whose projection is a record rather than rows.
    single: bool = False
    #: Columns of a series' start, end and period, until it is expanded.
    series: tuple[str, str, str] | None = None


@dataclass
class Ctx:
    """Where names are looked up: a row, its bindings, outputs, and what lies around."""

    df: DataFrame
    cur: Row
    rows: dict[str, Row]
    ids: list[str]
    above: Ctx | None = None
    outputs: Callable[[str], Val] | None = None
    group: Rel | None = None
    touched: bool = False
    #: In a selector's condition: the row under test, after the row outside.
    fallback: Row | None = None


class Compiler:
    def __init__(self, model: Model, frames: Mapping[tuple, DataFrame], params: Mapping[str, Val], now: Column, rounding: str = "half_up", hosts: Registry | None = None, position: str = "view", request: str = "0"):
        self.model, self.frames, self.params, self.now, self.rounding = model, frames, dict(params), now, rounding
        self.hosts, self.position = hosts or Registry(), position
        self.request, self.uuids = request, 0
        self.locals: dict[str, Rel] = {}
        self.computing: list[tuple] = []
        root = self.scan(model.root)
        root.single = True
        self.root = root
        self.top = Ctx(root.df, root.cur, {}, [])

    # collections

    def scan(self, shape: Shape) -> Rel:
        """A collection with columns of its own names, key order, computed fields on demand."""
        df = self.frames[shape.path]
        names = {c: fresh(c) for c in df.columns}
        df = df.select(*[F.col(c).alias(n) for c, n in names.items()])
        columns = {n: Val(F.col(names[n]), f.kind, f.optional, f) for n, f in shape.fields.items() if f.computed is None}
        ids = [names[c] for c in shape.ids()]
        rel = Rel(df, Row(columns, shape, ids), ids, shape.relation)
        if shape.bucket:
            self.bucketed(rel, shape)
        return rel

    def bucketed(self, rel: Rel, shape: Shape) -> None:
        ctx = Ctx(rel.df, rel.cur, {}, rel.ids)
        start, end = shape.bucket.get("$from"), shape.bucket.get("$until")
        lo = self.scalar(start, ctx).col if start is not None else F.lit(None).cast("timestamp")
        hi = self.scalar(end, ctx).col if end is not None else F.lit(None).cast("timestamp")
        a, b = fresh("from"), fresh("until")
        rel.df = ctx.df.withColumns({a: lo.cast("timestamp"), b: hi.cast("timestamp")})
        rel.cur.structural |= {"from": Val(F.col(a), "timestamp", True), "until": Val(F.col(b), "timestamp", True)}
        rel.temporal = True

    def generated(self, shape: Shape) -> Rel:
        """A bucket made from another view: one interval, or a series, for each of its rows."""
        rel = self.view(shape.bucket["$source"], self.top)
        source = rel.cur
        ctx = Ctx(rel.df, Row({}, None, rel.ids, {}), {"$source": source}, rel.ids)
        lo = self.scalar(shape.bucket["$from"], ctx).col.cast("timestamp")
        hi = self.scalar(shape.bucket["$until"], ctx).col.cast("timestamp") if "$until" in shape.bucket else F.lit(None).cast("timestamp")
        period = self.scalar(shape.bucket["$repeat"], ctx).col if "$repeat" in shape.bucket else F.lit(None).cast("string")
        a, b, p = fresh("start"), fresh("end"), fresh("period")
        df = ctx.df.withColumns({a: lo, b: hi, p: period})
        out = Rel(df, Row({}, shape, list(rel.ids), {}), list(rel.ids), shape.relation, rows={"$source": source}, order=list(rel.order))
        out.cur.structural = {"source": Val(F.struct(*[v.col.alias(n) for n, v in source.columns.items()]), "row")}
        out.series = (a, b, p)
        out.temporal, out.unbounded = True, "$repeat" in shape.bucket
        return out

    def expand(self, rel: Rel, lo: Column, hi: Column | None) -> Rel:
        """The intervals of a series that meet [lo, hi), or hold lo where hi is none."""
        a, b, p = rel.series
        start, end, period = F.col(a), F.col(b), F.col(p)
        stop = (hi if hi is not None else times.shifted(lo, 1)).cast("timestamp")
        fixed = F.coalesce(_days(period, "D", 86_400_000_000), _days(period, "W", 604_800_000_000), _hours(period))
        months = F.coalesce(_days(period, "M", 1), _days(period, "Y", 12))
        bound = F.least(F.coalesce(end, stop), stop)
        n_fixed = F.call_function("div", F.unix_micros(bound) - F.unix_micros(start) + fixed - 1, fixed)
        n_months = (F.ceil(F.months_between(bound, start) / months) + 1).cast("long")
        n = F.when(period.isNull(), F.lit(1)).when(fixed.isNotNull(), n_fixed).when(months.isNotNull(), n_months).otherwise(F.raise_error(F.lit("a period that does not advance")).cast("long"))
        n = F.when(n > 200_000, F.raise_error(F.lit("too many intervals")).cast("long")).otherwise(F.greatest(n, F.lit(0)))
        i, f, u, m = fresh("index"), fresh("from"), fresh("until"), fresh("n")
        df = rel.df.withColumn(m, n.cast("long")).where(F.col(m) > 0).withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        at = lambda k: F.when(period.isNull(), start).when(fixed.isNotNull(), times.shifted(start, k * fixed)).otherwise(start + F.make_ym_interval(F.lit(0), (k * months).cast("int")))
        last = F.when(period.isNull(), end).otherwise(F.least(at(F.col(i) + 1), end))
        df = df.withColumns({f: at(F.col(i)), u: last})
        out = replace(rel, df=df, unbounded=False, series=None, ids=[*rel.ids, f], order=[*rel.order] or [])
        out.cur = Row(dict(rel.cur.columns), rel.cur.shape, [*rel.ids, f], dict(rel.cur.structural))
        out.cur.structural |= {"from": Val(F.col(f), "timestamp"), "until": Val(F.col(u), "timestamp", True), "index": Val(F.col(i), "int")}
        for name, decl in rel.cur.shape.fields.items():
            if decl.computed is not None:
                ctx = Ctx(out.df, out.cur, out.rows, out.ids)
                v = self.scalar(decl.computed, ctx)
                c = fresh(name)
                out.df = ctx.df.withColumn(c, v.col)
                out.cur.columns[name] = replace(v, col=F.col(c))
        return out

    def active(self, rel: Rel, lo: Column, hi: Column | None = None) -> Rel:
        if rel.series is not None:
            rel = self.expand(rel, lo, hi)
        f, u = rel.cur.structural["from"].col, rel.cur.structural["until"].col
        keep = (f <= lo) & (u.isNull() | (lo < u)) if hi is None else (f < hi) & (u.isNull() | (u > lo))
        return replace(rel, df=rel.df.where(keep), temporal=False, unbounded=False)

    def now_if_temporal(self, rel: Rel) -> Rel:
        """A bucket that is read without a time is read at the request's."""
        return self.active(rel, self.now) if rel.temporal else rel

    # views

    def view(self, node: Node, ctx: Ctx) -> Rel:
        rel = self.try_view(node, ctx)
        if rel is None:
            raise StaticError(f"not a view: {node}")
        return rel

    def try_view(self, node: Node, ctx: Ctx) -> Rel | None:
        op = node.op
        if op == "group":
            return self.try_view(node[0], ctx)
        if op == "root":
            return self.member_view(self.top, node[0], rooted=True) if node[0] else self.root
        if op == "current":
            if node[0] is None:
                return self.root if ctx is self.top else None
            if node[0].startswith("$"):
                return None
            return self.member_view(ctx, node[0])
        if op == "name":
            if node[0] in self.locals:
                return self.locals[node[0]]
            if node[0] == "group" and ctx.group is not None:
                return ctx.group
            if node[0] in ctx.rows or node[0] in ctx.cur.columns:
                return None
            return self.member_view(ctx, node[0])
        if op == "list" and not node.args:
            return replace(self.root, df=self.root.df.where(F.lit(False)), outs=[], single=False)
        if op == "member":
            return self.member_of(node[0], node[1], ctx)
        if op == "traverse":
            left = self.bound(node[0], ctx)
            return self.traverse(left, node[1], node[1])
        if op == "call" and node[0].op in ("member", "current") and str(node[0].args[-1]).startswith("$"):
            base = self.view(node[0][0], ctx) if node[0].op == "member" else None
            return self.timed(base, node[0].args[-1], node[1], ctx)
        if op == "select":
            return self.select(node, ctx)
        if op == "block":
            base = self.try_view(node[0], ctx)
            return None if base is None else self.project(base, node[1], ctx)
        if op == "combine":
            return self.combine(node[0], self.view(node[1], ctx), self.view(node[2], ctx), ctx)
        if op == "binary" and node[0] in ("-", "??"):
            left = self.try_view(node[1], ctx)
            if left is None:
                return None
            right = self.view(node[2], ctx)
            return self.combine("-", left, right, ctx) if node[0] == "-" else self.fallback(left, right, ctx)
        if op == "if":
            then = self.try_view(node[1], ctx)
            if then is None:
                return None
            test = self.boolean(self.scalar(node[0], ctx))
            return self.choose(test, then, self.view(node[2], ctx), ctx)
        return None

    def member_view(self, ctx: Ctx, name: str, rooted: bool = False) -> Rel | None:
        """A collection or named view under the row."""
        shape = self.model.root if rooted else ctx.cur.shape
        if shape is None:
            return None
        if name in shape.views:
            return self.view(shape.views[name], ctx if not rooted else self.top)
        if name not in shape.children:
            return None
        child = shape.children[name]
        if "$source" in child.bucket:
            return self.generated(child)
        rel = self.scan(child)
        if shape.path and not rooted:
            rel.outside = [F.col(c) == F.col(p) for c, p in zip(rel.ids, ctx.cur.ids, strict=False)]
            ctx.touched = True
        return rel

    def member_of(self, node: Node, name: str, ctx: Ctx) -> Rel | None:
        """``view.member``: a nested collection of every row, or a time selector without arguments."""
        if node.op == "name" and node[0] in ctx.rows:
            row = ctx.rows[node[0]]
            inner = Ctx(ctx.df, row, ctx.rows, ctx.ids, ctx.above)
            out = self.member_view(inner, name)
            ctx.touched = ctx.touched or inner.touched
            return out
        base = self.try_view(node, ctx)
        if base is None or base.single:
            return self.member_view(self.top, name) if base is not None else None
        if name.startswith("$"):
            return self.timed(base, name, (), ctx)
        shape = base.cur.shape
        if base.outs is None and shape is not None and (name in shape.children):
            return self.traverse(base, name, None)
        return None

    def bound(self, node: Node, ctx: Ctx) -> Rel:
        """A view whose rows go by its last name: ``a::b`` is ``a[:a].b[:b]``."""
        rel = self.view(node, ctx)
        name = str(node.args[-1]) if node.op in ("current", "root", "name", "member", "traverse") else None
        return replace(rel, rows=rel.rows | ({name: rel.cur} if name else {}))

    def traverse(self, base: Rel, name: str, bind: str | None) -> Rel:
        base = self.now_if_temporal(base)
        shape = base.cur.shape
        if shape is None or name not in shape.children:
            raise StaticError(f"unknown member {name}")
        child = self.now_if_temporal(self.scan(shape.children[name]))
        on = [F.col(c) == F.col(p) for c, p in zip(child.ids, base.cur.ids, strict=False)]
        df = base.df.join(child.df, on)
        order = []
        if base.order:
            order = [*base.order, *((c, False) for c in child.ids)]
        rows = base.rows | ({bind: child.cur} if bind else {})
        return Rel(df, child.cur, child.ids, child.relation, rows, order, list(base.outside))

    def timed(self, base: Rel, name: str, args: tuple, ctx: Ctx) -> Rel:
        if base is None or not base.temporal:
            raise StaticError(f"{name} needs a collection with intervals")
        values = [self.scalar(a, ctx).col.cast("timestamp") for a in args]
        if name == "$all":
            if base.unbounded:
                raise StaticError("an endless series is read only at an instant or between two")
            return replace(self.expand(base, self.now, F.lit("9999-01-01").cast("timestamp")) if base.series is not None else base, temporal=False)
        if name == "$at" and len(values) == 1:
            return self.active(base, values[0])
        if name == "$between" and len(values) == 2:
            return self.active(base, *values)
        raise StaticError(f"unknown selector {name}")

    def inner(self, rel: Rel, ctx: Ctx) -> Ctx:
        return Ctx(rel.df, rel.cur, {**ctx.rows, **rel.rows}, rel.ids, above=ctx, group=None)

    def select(self, node: Node, ctx: Ctx) -> Rel:
        base = self.view(node[0], ctx)
        if base.single:
            raise StaticError("the root is not a collection")
        sel = node[1]
        if sel.op == "bind":
            base = self.now_if_temporal(base) if not (base.unbounded and sel[1] is None) else base
            name, condition = sel.args
            base = replace(base, rows=base.rows | {name: base.cur}, outside=list(base.outside))
            if condition is None:
                return base
            inside = self.inner(base, ctx)
            # a dot in the condition is the row outside
            inside.cur = ctx.cur
            was, ctx.touched = ctx.touched, False
            inside.fallback = base.cur
            plain: list[Column] = []
            for part in _conjuncts(condition):
                # what reads the row outside becomes a join condition, the rest a filter under the join
                before, ctx.touched = ctx.touched, False
                test = self.boolean(self.scalar(part, inside))
                (base.outside if ctx.touched else plain).append(test)
                ctx.touched = before or ctx.touched
            base.df = inside.df
            for test in plain:
                base.df = base.df.where(test)
            ctx.touched = was or ctx.touched
            return base
        return self.by_keys(self.now_if_temporal(base), sel.args, ctx)

    def by_keys(self, base: Rel, keys: tuple[Node, ...], ctx: Ctx) -> Rel:
        shape = base.cur.shape
        own = base.cur.ids[-len(shape.key) :]
        n = len(shape.key)
        wanted: list[list[Val]] = []
        if n > 1 and all(k.op != "object" for k in keys):
            # the components one after another
            if len(keys) % n:
                raise StaticError("a key must have exactly the key's components")
            wanted = [[self.scalar(k, ctx) for k in keys[i : i + n]] for i in range(0, len(keys), n)]
        else:
            for k in keys:
                if k.op == "object":
                    given = {m[0]: m[1] for m in k.args if m.op == "output"} | {m[0][0]: m[0] for m in k.args if m.op == "short"}
                    if set(given) != set(shape.key):
                        raise StaticError("a key must have exactly the key's components")
                    wanted.append([self.scalar(given[c], ctx) for c in shape.key])
                else:
                    v = self.scalar(k, ctx)
                    if v.kind == "set":
                        return self.by_set(base, v, own[0], ctx)
                    self.comparable(v, shape.fields[shape.key[0]], shape)
                    wanted.append([v])
        base = replace(base, outside=list(base.outside))
        if len(wanted) == 1:
            base.outside += [F.col(c) == v.col.cast(base.df.schema[c].dataType) for c, v in zip(own, wanted[0], strict=True)]
            ctx.touched = True
            return base
        at, item = fresh("at"), fresh("key")
        parts = F.array(*[F.struct(*[v.col.cast(base.df.schema[c].dataType).alias(c) for c, v in zip(own, w, strict=True)]) for w in wanted])
        df = ctx.df.select("*", F.posexplode(parts).alias(at, item)) if ctx is not self.top else ctx.df.select(F.posexplode(parts).alias(at, item))
        if ctx is not self.top:
            raise StaticError("several keys at once are selected from the root")
        base.df = base.df.join(F.broadcast(df), [F.col(c) == F.col(item)[c] for c in own])
        base.order = [(at, False)]
        return base

    def by_set(self, base: Rel, v: Val, own: str, ctx: Ctx) -> Rel:
        if ctx is not self.top:
            raise StaticError("a set of keys is selected from the root")
        at, item = fresh("at"), fresh("key")
        df = ctx.df.select(F.posexplode(F.array_sort(F.array_distinct(v.col))).alias(at, item))
        return replace(base, df=base.df.join(df, F.col(own) == F.col(item)), order=[(at, False)])

    def closed(self, rel: Rel, ctx: Ctx) -> Rel:
        """A view at the top, where the only row outside is the root."""
        if rel.unbounded:
            raise StaticError("an endless series is read only at an instant or between two")
        rel = self.now_if_temporal(rel)
        if rel.outside:
            on = rel.outside[0]
            for c in rel.outside[1:]:
                on = on & c
            need_root = any(col in str(on) for col in ctx.df.columns)
            df = rel.df.join(F.broadcast(ctx.df), on) if need_root else rel.df.where(on)
            rel = replace(rel, df=df, outside=[])
        return rel

    def bounded(self, rel: Rel) -> Rel:
        if not rel.skip and rel.limit is None:
            return rel
        if rel.outside:
            raise StaticError("the first rows for each row outside are shown, but not read any further")
        df = rel.df.orderBy(*self.ordering(rel))
        df = df.offset(rel.skip) if rel.skip else df
        df = df.limit(rel.limit) if rel.limit is not None else df
        return replace(rel, df=df, skip=0, limit=None)

    def ordering(self, rel: Rel) -> list[Column]:
        return [(desc if d else asc)(c) for c, d in rel.order] + [asc(c) for c in rel.ids]

    # projection and grouping

    def project(self, base: Rel, block: tuple[Node, ...], ctx: Ctx) -> Rel:
        base = self.now_if_temporal(base)
        if base.skip or base.limit is not None:
            base = self.bounded(self.closed(base, ctx) if ctx is self.top else base)
        if base.unbounded:
            raise StaticError("an endless series is read only at an instant or between two")
        directives = {m[0]: m[1] for m in block if m.op == "directive"}
        if unknown := set(directives) - {"$key", "$sort", "$skip", "$limit", "$quantity"}:
            raise StaticError(f"unknown directive {sorted(unknown)[0]}")
        outs: dict[str, Node] = {}
        for m in block:
            if m.op == "output":
                outs[m[0]] = m[1]
            elif m.op == "short":
                outs[self.short_name(m[0])] = m[0]
            elif m.op != "directive":
                raise StaticError("a projection does not change rows")
        if "$key" in directives:
            if base.outside:
                raise StaticError("groups are made of a view without a row outside")
            rel = self.grouped(base, directives["$key"], outs, ctx)
        else:
            rel = self.projected(base, outs, directives.get("$sort"), ctx)
        for name in ("$skip", "$limit"):
            if name in directives:
                n = directives[name]
                if n.op != "int":
                    raise StaticError(f"{name} takes an integer from 0 on")
                rel = replace(rel, **{name[1:]: int(n[0])})
        if "$key" in directives and "$sort" in directives:
            rel.order = self.sorted_by(directives["$sort"], {n: F.col(c) for n, c in rel.outs}, rel)
        return rel

    def short_name(self, node: Node) -> str:
        if node.op in ("name", "param", "structural", "current", "root") and node[0]:
            return node[0]
        if node.op == "member":
            return node[1]
        raise StaticError("an output has no name")

    def projected(self, base: Rel, outs: dict[str, Node], sort: Node | None, ctx: Ctx) -> Rel:
        inside = self.inner(base, ctx)
        done: dict[str, Val] = {}
        open_: list[str] = []

        def output(name: str) -> Val:
            if name not in done:
                if name in open_:
                    raise StaticError(f"outputs read each other in a circle: {' -> '.join([*open_, name])}")
                open_.append(name)
                value = self.value(outs[name], inside)
                open_.pop()
                c = fresh(name)
                inside.df = inside.df.withColumn(c, value.col)
                done[name] = replace(value, col=F.col(c))
            return done[name]

        inside.outputs = lambda name: output(name) if name in outs else None
        for name in outs:
            output(name)
        rel = replace(base, outs=[(n, _column_name(done[n])) for n in outs])
        if sort is not None:
            keys = self.sort_keys(sort, inside)
            rel.order = []
            for v, d in keys:
                k = fresh("sort")
                inside.df = inside.df.withColumn(k, v.col)
                rel.order.append((k, d))
        rel.df = inside.df
        rel.cur = Row({n: done[n] for n in outs}, None, base.ids)
        rel.rows = {}
        return rel

    def sort_keys(self, sort: Node, ctx: Ctx) -> list[tuple[Val, bool]]:
        out = []
        for k in sort.args if sort.op == "list" else (sort,):
            if k.op == "object":
                d = {m[0]: m[1] for m in k.args}
                out.append((self.scalar(d["$by"], ctx), d.get("$dir", Node("name", ("asc",)))[0] == "desc"))
            elif k.op == "unary" and k[0] == "-":
                out.append((self.scalar(k[1], ctx), True))
            elif k.op == "text":
                out.append((self.scalar(Node("name", (k[0],)), ctx), False))
            else:
                out.append((self.scalar(k, ctx), False))
        return [(self.sortable(v), d) for v, d in out]

    def sortable(self, v: Val) -> Val:
        from ..functions.order import enum_key
        from ..functions.values import json_key

        if v.kind == "enum" and v.decl is not None:
            return replace(v, col=enum_key(v.col, v.decl.labels))
        return replace(v, col=json_key(v.col)) if v.kind == "json" else v

    def sorted_by(self, sort: Node, columns: Mapping[str, Column], rel: Rel) -> list[tuple[str, bool]]:
        ctx = Ctx(rel.df, rel.cur, {}, rel.ids)
        out = []
        for v, d in self.sort_keys(sort, ctx):
            k = fresh("sort")
            rel.df = rel.df.withColumn(k, v.col)
            out.append((k, d))
        return out

    def grouped(self, base: Rel, key: Node, outs: dict[str, Node], ctx: Ctx) -> Rel:
        inside = self.inner(self.closed(base, self.top), ctx)
        parts = key.args if key.op == "list" else (key,)
        if any(_reads(p, "group") for p in parts):
            raise StaticError("a group's key does not read the group")
        keys = []
        for p in parts:
            v = self.scalar(outs.get(p[0], p) if p.op == "name" and p[0] not in inside.cur.columns else p, inside)
            c = fresh("key")
            inside.df = inside.df.withColumn(c, v.col)
            keys.append((p, replace(v, col=F.col(c)), c))
        members = replace(base, df=inside.df)
        shaped = Ctx(inside.df, inside.cur, inside.rows, [], above=ctx, group=members)
        aggregates: dict[str, Column] = {}
        columns: dict[str, Val] = {}
        for name, node in outs.items():
            hit = next((v for p, v, _ in keys if p == node or (p.op == "name" and p[0] == name and node == p)), None)
            if hit is not None:
                columns[name] = hit
                continue
            columns[name] = self.over_group(node, shaped, [(p, v) for p, v, _ in keys], aggregates)
        df = inside.df.groupBy(*[c for _, _, c in keys]).agg(*[a.alias(n) for n, a in aggregates.items()]) if aggregates else inside.df.select(*[c for _, _, c in keys]).distinct()
        final = {n: fresh(n) for n in outs}
        df = df.withColumns({final[n]: columns[n].col for n in outs})
        ids = [c for _, _, c in keys]
        cur = Row({n: replace(columns[n], col=F.col(final[n])) for n in outs}, None, ids)
        return Rel(df, cur, ids, f"{base.relation}/group", outs=[(n, final[n]) for n in outs])

    def over_group(self, node: Node, ctx: Ctx, keys: list[tuple[Node, Val]], aggregates: dict[str, Column]) -> Val:
        """A scalar over a group: aggregates become columns of the aggregation, the rest is computed after it."""
        for p, v in keys:
            if p == node:
                return v
        if node.op == "call" and node[0].op == "name" and node[0][0] in (*AGGREGATES, "size") and _reads(node, "group"):
            v = self.group_aggregate(node, ctx)
            c = fresh("agg")
            aggregates[c] = v.col
            return replace(v, col=F.col(c))
        if node.op == "binary":
            return self.arithmetic(node[0], self.over_group(node[1], ctx, keys, aggregates), self.over_group(node[2], ctx, keys, aggregates))
        if node.op in ("int", "decimal", "text", "bool", "none", "param"):
            return self.scalar(node, ctx)
        raise StaticError("an output of a group is aggregated or comes from its key")

    def group_aggregate(self, node: Node, ctx: Ctx) -> Val:
        target, name = node[1][0], node[0][0]
        condition, member = None, None
        if target.op == "member":
            target, member = target[0], target[1]
        rows = dict(ctx.rows)
        if target.op == "select":
            bind, cond = target[1].args
            rows[bind] = ctx.cur
            inner = Ctx(ctx.df, ctx.cur, rows, ctx.ids)
            condition = logic.true(self.boolean(self.scalar(cond, inner)))
        x = self.field(ctx.cur, member) if member else None
        pick = lambda col: col if condition is None else F.when(condition, col)
        return self.aggregated(name, x, pick)

    def aggregated(self, name: str, x: Val | None, pick: Callable[[Column], Column]) -> Val:
        if name in ("count", "size"):
            return Val(F.count(pick(F.lit(1))).cast("long"), "int")
        if x is None:
            raise StaticError(f"{name} needs a field")
        if name in ("sum", "avg") and x.kind not in NUMBERS:
            raise StaticError(f"{name} needs numbers")
        if name == "sum":
            return Val(sum_of(pick(x.col)).cast(SCALARS[x.kind]), x.kind)
        if name == "avg":
            return Val(avg_of(pick(x.col), self.rounding), "decimal", True)
        if name == "distinct":
            return Val(distinct_of(pick(x.col)), "set", decl=Field("set", element=x.decl or Field(x.kind)))
        f = F.min if name == "min" else F.max
        return Val(f(pick(x.col)), x.kind, True, x.decl)

    # combinators

    def aligned(self, a: Rel, b: Rel, ctx: Ctx) -> tuple[Rel, Rel]:
        a, b = (self.bounded(self.whole(r)) for r in (self.closed(a, ctx), self.closed(b, ctx)))
        if a.relation != b.relation or len(a.ids) != len(b.ids):
            raise StaticError(f"views of {a.relation} and {b.relation} have no identity in common")
        if [n for n, _ in a.outs] != [n for n, _ in b.outs] and {n for n, _ in a.outs} != {n for n, _ in b.outs}:
            raise StaticError("combined views must have the same fields")
        return a, b

    def whole(self, rel: Rel) -> Rel:
        """Rows that were not projected show all their fields."""
        if rel.outs is not None:
            return rel
        columns = {n: v for n, v in rel.cur.columns.items()}
        return replace(rel, outs=[(n, _column_name(v)) for n, v in columns.items()])

    def combine(self, mark: str, a: Rel, b: Rel, ctx: Ctx) -> Rel:
        if mark in ("|",):
            a, b = self.aligned(a, b, ctx)
            on = [F.col(y).eqNullSafe(F.col(x)) for x, y in zip(a.ids, b.ids, strict=True)]
            rest = replace(b, df=b.df.join(a.df.select(*a.ids), on, "left_anti").dropDuplicates(b.ids))
            return self.stacked(a, rest)
        a, b = self.closed(a, ctx), self.closed(b, ctx)
        if a.relation != b.relation:
            raise StaticError(f"views of {a.relation} and {b.relation} have no identity in common")
        a, b = self.bounded(a), self.bounded(b)
        on = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a.ids, b.ids, strict=True)]
        return replace(a, df=a.df.join(b.df.select(*b.ids), on, "left_semi" if mark == "&" else "left_anti"))

    def stacked(self, a: Rel, b: Rel) -> Rel:
        """The left's rows before the right's, each in its order."""
        side, names = fresh("side"), {n: fresh(n) for n, _ in a.outs}
        ids, width = [fresh("id") for _ in a.ids], max(len(a.order), len(b.order))
        keys = [fresh("sort") for _ in range(width)]
        if [d for _, d in a.order] != [d for _, d in b.order]:
            raise StaticError("combined views must be sorted alike")
        frames = []
        for k, r in enumerate((a, b)):
            cols = dict(r.outs)
            frames.append(r.df.select(F.lit(k).alias(side), *[F.col(cols[n]).alias(c) for n, c in names.items()], *[F.col(x).alias(y) for x, y in zip(r.ids, ids, strict=True)], *[F.col(x).alias(y) for (x, _), y in zip(r.order, keys, strict=False)]))
        order = [(side, False), *((k, d) for k, (_, d) in zip(keys, a.order, strict=False))]
        cur = Row({n: replace(a.cur.columns[n], col=F.col(c)) for n, c in names.items() if n in a.cur.columns}, a.cur.shape, ids)
        return Rel(frames[0].unionByName(frames[1]), cur, ids, a.relation, order=order, outs=list(names.items()))

    def fallback(self, a: Rel, b: Rel, ctx: Ctx) -> Rel:
        a, b = self.bounded(self.whole(self.closed(a, ctx))), self.bounded(self.whole(self.closed(b, ctx)))
        flag = fresh("some")
        some = a.df.limit(1).agg(F.count(F.lit(1)).alias(flag))
        return self.stacked(a, replace(b, df=b.df.join(F.broadcast(some), F.col(flag) == 0)))

    def choose(self, test: Column, a: Rel, b: Rel, ctx: Ctx) -> Rel:
        a, b = self.whole(self.closed(a, ctx)), self.whole(self.closed(b, ctx))
        flag = fresh("chosen")
        root = F.broadcast(ctx.df.select(logic.true(test).alias(flag)))
        if not b.outs:
            return replace(a, df=a.df.join(root, F.col(flag)))
        return self.stacked(replace(a, df=a.df.join(root, F.col(flag))), replace(b, df=b.df.join(root, ~F.col(flag))))

    # scalars

    def field(self, row: Row, name: str) -> Val:
        if name in row.columns:
            return row.columns[name]
        raise StaticError(f"unknown name {name}")

    def row_field(self, row: Row, name: str, ctx: Ctx) -> Val | None:
        """A stored field, or a computed one, which is worked out in the row's own scope."""
        if name in row.columns:
            return row.columns[name]
        decl = row.shape.fields.get(name) if row.shape is not None else None
        if decl is None or decl.computed is None:
            return None
        mark = (row.shape.path, name)
        if mark in self.computing:
            raise StaticError(f"{name} is computed from itself")
        self.computing.append(mark)
        own = Ctx(ctx.df, row, {"$source": ctx.rows["$source"]} if "$source" in ctx.rows else {}, ctx.ids or row.ids, above=None)
        v = self.scalar(decl.computed, own)
        ctx.df = own.df
        self.computing.pop()
        return v

    def value(self, node: Node, ctx: Ctx) -> Val:
        """An output: a scalar, a struct, or a nested view as an array of records."""
        if node.op == "object":
            parts = {m[0]: self.value(m[1], ctx) for m in node.args if m.op == "output"}
            return Val(F.struct(*[v.col.alias(n) for n, v in parts.items()]), "struct")
        if node.op in ("block", "select", "traverse") or (node.op in ("current", "name", "member") and self.is_view(node, ctx)):
            rel = self.try_view(node, ctx)
            if rel is not None and not rel.single:
                return self.nested(rel, ctx)
        return self.scalar(node, ctx)

    def is_view(self, node: Node, ctx: Ctx) -> bool:
        name = node.args[-1]
        shape = ctx.cur.shape
        return node.op in ("current", "name") and shape is not None and (name in shape.children or name in shape.views) and name not in ctx.cur.columns

    def nested(self, rel: Rel, ctx: Ctx) -> Val:
        rel = self.whole(self.now_if_temporal(rel))
        keys = [*rel.order, *((c, False) for c in rel.ids)]
        item = F.struct(*[x.alias(f"s{i}") for i, x in enumerate(y for k, _ in keys for y in (F.col(k).isNull(), F.col(k)))], F.struct(*[F.col(c).alias(n) for n, c in rel.outs]).alias("row"))
        rows = F.collect_list(item)
        if any(d for _, d in keys):
            down = [d for _, d in keys for _ in range(2)]
            rows = F.array_sort(rows, lambda x, y: _compared(x, y, down))
        else:
            rows = F.array_sort(rows)
        if rel.skip or rel.limit is not None:
            rows = F.slice(rows, rel.skip + 1, F.size(rows) if rel.limit is None else F.lit(rel.limit))
        return self.joined_aggregate(replace(rel, skip=0, limit=None), Val(F.transform(rows, lambda x: x["row"]), "view"), ctx, empty=F.array())

    def joined_aggregate(self, rel: Rel, v: Val, ctx: Ctx, empty: Column | None) -> Val:
        """An aggregate over the view's rows for each row of the context, by a grouped left join."""
        c = fresh("agg")
        if not rel.outside:
            one = rel.df.agg(v.col.alias(c))
            k = fresh("one")
            ctx.df = ctx.df.withColumn(k, F.lit(1)).join(F.broadcast(one.withColumn(k + "r", F.lit(1))), F.col(k) == F.col(k + "r"), "left").drop(k, k + "r")
            return replace(v, col=F.col(c))
        on = rel.outside[0]
        for x in rel.outside[1:]:
            on = on & x
        if not ctx.ids and ctx is not self.top:
            raise StaticError("an aggregate per row needs rows with an identity")
        ctx.touched = True
        need = [n for n in ctx.df.columns if n in ctx.ids or f"{n}" in str(on)]
        outer = ctx.df.select(*need).distinct()
        joined = outer.join(rel.df, on)
        by = ctx.ids or need or None
        if by:
            grouped = joined.groupBy(*by).agg(v.col.alias(c))
            names = {b: fresh("on") for b in by}
            right = grouped.select(c, *[F.col(b).alias(n) for b, n in names.items()])
            ctx.df = ctx.df.join(right, [F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()], "left").drop(*names.values())
        else:
            k = fresh("one")
            ctx.df = ctx.df.withColumn(k, F.lit(1)).join(F.broadcast(joined.agg(v.col.alias(c)).withColumn(k + "r", F.lit(1))), F.col(k) == F.col(k + "r"), "left").drop(k, k + "r")
        col = F.col(c) if empty is None else F.coalesce(F.col(c), empty.cast(ctx.df.schema[c].dataType))
        return replace(v, col=col)

    def single_field(self, rel: Rel, name: str, ctx: Ctx) -> Val:
        """The field of the one row that a selector names; none where it names no row for a row of a view."""
        rel = self.now_if_temporal(rel)
        inside = Ctx(rel.df, rel.cur, rel.rows, rel.ids)
        v = self.row_field(rel.cur, name, inside)
        if v is None:
            raise StaticError(f"unknown name {name}")
        c = fresh(name)
        right = inside.df.withColumn(c, v.col)
        if not rel.outside:
            raise StaticError("a field is read of exactly one row")
        on = rel.outside[0]
        for x in rel.outside[1:]:
            on = on & x
        used = [k for k in right.columns if k in str(on)]
        ctx.df = ctx.df.join(right.select(*dict.fromkeys([*used, c])), on, "left")
        return replace(v, col=F.col(c), optional=v.optional)

    def lookup(self, name: str, ctx: Ctx) -> Val:
        v = self.row_field(ctx.cur, name, ctx)
        if v is not None:
            if ctx.fallback is not None and ctx.above is not None:
                ctx.above.touched = True
            return v
        if ctx.fallback is not None and (v := self.row_field(ctx.fallback, name, ctx)) is not None:
            return v
        if name in ctx.cur.structural:
            return ctx.cur.structural[name]
        if ctx.outputs is not None and (v := ctx.outputs(name)) is not None:
            return v
        if ctx.above is not None:
            ctx.above.touched = True
            return self.lookup(name, ctx.above)
        raise StaticError(f"unknown name {name}")

    def scalar(self, node: Node, ctx: Ctx) -> Val:
        op, a = node.op, node.args
        if op == "group":
            return self.scalar(a[0], ctx)
        if op == "int":
            return Val(F.lit(int(a[0])).cast("long"), "int")
        if op == "decimal":
            return Val(F.lit(a[0]).cast(SCALARS["decimal"]), "decimal")
        if op == "text":
            return Val(F.lit(a[0]), "text")
        if op == "bool":
            return Val(F.lit(a[0]), "bool")
        if op == "literal":
            return Val(F.lit(a[0]), "bool" if isinstance(a[0], bool) else "int" if isinstance(a[0], int) else "text")
        if op == "none":
            return Val(F.lit(None), "none", True)
        if op == "param":
            if a[0] not in self.params:
                raise StaticError(f"unknown parameter {a[0]}")
            return self.params[a[0]]
        if op == "name":
            if a[0] in self.locals:
                raise StaticError(f"{a[0]} is a row")
            return self.lookup(a[0], ctx)
        if op == "structural":
            where = ctx
            while where is not None:
                if a[0] in where.cur.structural:
                    return where.cur.structural[a[0]]
                where = where.above
            raise StaticError(f"unknown ${a[0]}")
        if op == "current" and a[0]:
            if a[0] == "$key":
                return Val(F.col(ctx.cur.ids[-1]), "text")
            v = self.row_field(ctx.cur, a[0], ctx)
            if v is not None:
                if ctx.fallback is not None and ctx.above is not None:
                    ctx.above.touched = True
                return v
            if ctx.outputs is not None and (v := ctx.outputs(a[0])) is not None:
                return v
            raise StaticError(f"unknown name {a[0]}")
        if op == "root" and a[0]:
            v = self.row_field(self.root.cur, a[0], self.top)
            if v is None:
                raise StaticError(f"unknown name {a[0]}")
            return self.from_root(v, ctx)
        if op == "member":
            return self.member(node, ctx)
        if op == "unary":
            v = self.scalar(a[1], ctx)
            if a[0] == "!":
                return Val(logic.negated(self.boolean(v)), "bool")
            self.number(v)
            return replace(v, col=-v.col)
        if op == "binary":
            return self.binary(node, ctx)
        if op == "if":
            test = self.boolean(self.scalar(a[0], ctx))
            then, other = self.scalar(a[1], ctx), self.scalar(a[2], ctx)
            kind = self.agreed(then, other)
            return Val(F.when(logic.true(test), then.col).otherwise(other.col), kind, then.optional or other.optional)
        if op == "list":
            parts = [self.scalar(x, ctx) for x in a]
            return Val(F.array_sort(F.array_distinct(F.array(*[p.col for p in parts]))), "set", decl=Field("set", element=Field(parts[0].kind if parts else "text")))
        if op == "object":
            parts = {m[0]: self.scalar(m[1], ctx) for m in a if m.op == "output"}
            return Val(F.struct(*[v.col.alias(n) for n, v in parts.items()]), "struct")
        if op == "call":
            return self.call(node, ctx)
        if op in ("select", "block"):
            raise StaticError("a view stands where a value is needed")
        raise StaticError(f"not a value: {op}")

    def from_root(self, v: Val, ctx: Ctx) -> Val:
        if ctx is self.top:
            return v
        where = ctx
        while where is not None:
            if where is self.top:
                ctx.touched = True
                return v
            where = where.above
        c, k = fresh("root"), fresh("one")
        one = self.top.df.select(v.col.alias(c), F.lit(1).alias(k + "r"))
        ctx.df = ctx.df.withColumn(k, F.lit(1)).join(F.broadcast(one), F.col(k) == F.col(k + "r")).drop(k, k + "r")
        return replace(v, col=F.col(c))

    def member(self, node: Node, ctx: Ctx) -> Val:
        base, name = node.args
        if base.op == "name" and base[0] in ctx.rows:
            row = ctx.rows[base[0]]
            if name == "$key":
                return Val(F.col(row.ids[-1]), "text")
            v = self.row_field(row, name, ctx)
            if v is None and name.lstrip("$") in row.structural:
                v = row.structural[name.lstrip("$")]
            if v is None:
                raise StaticError(f"unknown name {name}")
            # a binding from further out makes the condition read the row outside
            if ctx.above is not None and base[0] in ctx.above.rows and ctx.above.rows[base[0]] is row:
                ctx.above.touched = True
            return v
        if base.op == "structural" and "$" + base[0] in ctx.rows:
            return self.field(ctx.rows["$" + base[0]], name)
        if base.op == "parent":
            where = ctx
            for _ in range(base[0]):
                where = where.above
                if where is None:
                    raise StaticError("nothing lies around this row")
            ctx.above.touched = True
            return self.field(where.cur, name)
        rel = self.try_view(base, ctx)
        if rel is not None:
            if rel.single:
                return self.scalar(Node("root", (name,)), ctx)
            return self.single_field(rel, name, ctx)
        v = self.scalar(base, ctx)
        if v.kind == "struct" and (v.decl is None or name in v.decl.members):
            m = v.decl.members[name] if v.decl is not None else None
            return Val(v.col[name], m.kind if m else "text", m.optional if m else True, m)
        raise StaticError(f"unknown member {name}")

    def binary(self, node: Node, ctx: Ctx) -> Val:
        mark, left, right = node.args
        if mark in ("&&", "||"):
            x, y = (self.boolean(self.scalar(n, ctx)) for n in (left, right))
            return Val(logic.all_of(x, y) if mark == "&&" else logic.any_of(x, y), "bool")
        if mark == "in":
            return self.membership(left, right, ctx)
        if mark == "??":
            x, y = self.scalar(left, ctx), self.scalar(right, ctx)
            return Val(F.coalesce(x.col, y.col), self.agreed(x, y), y.optional)
        x, y = self.scalar(left, ctx), self.scalar(right, ctx)
        if mark in ("==", "!=", "<", "<=", ">", ">="):
            self.same_kind(x, y)
            f = {"==": logic.eq, "!=": logic.ne, "<": logic.lt, "<=": logic.le, ">": logic.gt, ">=": logic.ge}[mark]
            p, q = self.ordered(x, y, mark)
            if not (x.optional or y.optional) and "none" not in (x.kind, y.kind):
                # neither side is ever none: the bare comparison reaches the scan
                f = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[mark]
            return Val(f(p, q), "bool")
        return self.arithmetic(mark, x, y)

    def ordered(self, x: Val, y: Val, mark: str) -> tuple[Column, Column]:
        enum = next((v.decl for v in (x, y) if v.kind == "enum" and v.decl is not None), None)
        if enum is None or mark in ("==", "!="):
            return x.col, y.col
        from ..functions.order import enum_key

        return enum_key(x.col, enum.labels), enum_key(y.col, enum.labels)

    def arithmetic(self, mark: str, x: Val, y: Val) -> Val:
        if x.optional or y.optional:
            raise StaticError("arithmetic on what may be none")
        if mark == "+" and x.kind == y.kind == "text":
            return Val(F.concat(x.col, y.col), "text")
        if x.kind == "timestamp" and y.kind == "duration" and mark in "+-":
            return Val(times.shifted(x.col, y.col if mark == "+" else -y.col), "timestamp")
        self.number(x), self.number(y)
        if x.kind == y.kind == "int":
            col = {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}.get(mark)
            if col is None:
                col = arith.int_div(x.col, y.col) if mark == "/" else arith.rem(x.col, y.col)
            return Val(col, "int")
        if mark == "/":
            return Val(arith.quotient(x.col, y.col, self.rounding), "decimal")
        p, q = arith.term(x.col), arith.term(y.col)
        col = arith.product(x.col, y.col) if mark == "*" else {"+": p + q, "-": p - q, "%": p % q}[mark]
        return Val(col.cast(SCALARS["decimal"]), "decimal")

    def membership(self, left: Node, right: Node, ctx: Ctx) -> Val:
        x = self.scalar(left, ctx)
        rel = self.try_view(right, ctx)
        if rel is None:
            v = self.scalar(right, ctx)
            if v.kind != "set":
                raise StaticError("in needs a set or a view")
            return Val(logic.in_set(x.col, v.col), "bool")
        rel = self.now_if_temporal(rel)
        key = rel.ids[-1]
        rel = replace(rel, outside=[*rel.outside, F.col(key) == x.col])
        v = self.joined_aggregate(rel, Val(F.count(F.lit(1)), "int"), ctx, empty=F.lit(0))
        return Val(v.col > 0, "bool")

    def call(self, node: Node, ctx: Ctx) -> Val:
        target, args = node.args
        name = target[0] if target.op == "name" else f"{target[0][0]}.{target[1]}" if target.op == "member" and target[0].op == "name" else None
        if name in AGGREGATES or name == "size":
            got = self.aggregate(name, args[0], ctx)
            if got is not None:
                return got
        if name == "size":
            v = self.scalar(args[0], ctx)
            return Val(F.size(v.col).cast("long") if v.kind == "set" else text.size(v.col), "int")
        if name == "has":
            rel = self.try_view(args[0], ctx)
            if rel is not None:
                v = self.joined_aggregate(self.now_if_temporal(rel), Val(F.count(F.lit(1)), "int"), ctx, empty=F.lit(0))
                return Val(v.col > 0, "bool")
            return Val(logic.has(self.scalar(args[0], ctx).col), "bool")
        if name == "now":
            return Val(self.now, "timestamp")
        if name == "assert":
            return Val(logic.asserted(self.boolean(self.scalar(args[0], ctx)), args[1][0] if len(args) > 1 else "assertion"), "bool")
        if name == "time.duration":
            return Val(F.lit(times.duration(args[0][0])), "duration")
        if name == "uuid":
            # the request, the place in it, and the row, or among new rows its number
            self.uuids += 1
            return Val(times.seeded_uuid(f"{self.request}.{self.uuids}", self.now, *[F.col(c) for c in ctx.ids if c in ctx.df.columns]), "uuid")
        functions = {
            "string.lower": (text.lower, "text"),
            "string.upper": (text.upper, "text"),
            "string.casefold": (text.casefold, "text"),
            "string.trim": (text.trim, "text"),
            "string.bytes": (text.utf8_bytes, "bytes"),
            "string.from_bytes": (text.utf8_text, "text"),
            "base64.encode": (text.base64_encode, "text"),
            "base64.decode": (text.base64_decode, "bytes"),
            "hex.encode": (text.hex_encode, "text"),
            "hex.decode": (text.hex_decode, "bytes"),
            "sha.sha256": (lambda x: text.digest(x, 256), "text"),
            "sha.sha512": (lambda x: text.digest(x, 512), "text"),
            "convert.text": (lambda x: x.cast("string"), "text"),
            "convert.int": (lambda x: x.cast("long"), "int"),
            "convert.decimal": (lambda x: x.cast(SCALARS["decimal"]), "decimal"),
            "time.date": (lambda x: x.cast("date"), "date"),
            "time.micros": (F.unix_micros, "int"),
        }
        if name is not None and name in self.hosts.functions:
            values = [self.scalar(a, ctx) for a in args]
            kinds = {"StringType": "text", "LongType": "int", "BooleanType": "bool", "DecimalType": "decimal", "TimestampType": "timestamp", "BinaryType": "bytes", "DateType": "date"}
            try:
                col = self.hosts.call(name, [(v.col, v.kind) for v in values], self.position)
            except HostError as e:
                raise StaticError(str(e)) from e
            return Val(col, kinds.get(type(self.hosts.functions[name].result).__name__, "text"), True)
        if name not in functions:
            raise StaticError(f"unknown function {name}")
        f, kind = functions[name]
        v = self.scalar(args[0], ctx)
        return Val(f(v.col), kind, v.optional)

    def aggregate(self, name: str, arg: Node, ctx: Ctx) -> Val | None:
        member, target = None, arg
        rel = self.try_view(arg, ctx) if name in ("count", "size", "has") else None
        if rel is None and arg.op in ("member",):
            target, member = arg.args
            rel = self.try_view(target, ctx)
        if rel is None and member is None:
            rel = self.try_view(arg, ctx)
        if rel is None:
            if name == "size":
                return None
            raise StaticError(f"{name} needs a view")
        if rel.unbounded:
            raise StaticError("an endless series is read only at an instant or between two")
        rel = self.bounded(self.now_if_temporal(rel))
        x = None
        if member is not None:
            inside = Ctx(rel.df, rel.cur, rel.rows, rel.ids)
            x = self.row_field(rel.cur, member, inside)
            if x is None:
                raise StaticError(f"unknown name {member}")
            rel = replace(rel, df=inside.df)
        v = self.aggregated(name, x, lambda c: c)
        empty = {"count": F.lit(0), "size": F.lit(0), "sum": F.lit(0), "distinct": F.array()}.get(name)
        return self.joined_aggregate(rel, v, ctx, empty)

    # static rules

    def boolean(self, v: Val) -> Column:
        if v.kind not in ("bool", "none"):
            raise StaticError(f"{v.kind} is no condition")
        return v.col.cast("boolean")

    def number(self, v: Val) -> None:
        if v.kind not in NUMBERS:
            raise StaticError(f"{v.kind} is no number")
        if v.optional:
            raise StaticError("arithmetic on what may be none")

    def agreed(self, x: Val, y: Val) -> str:
        if x.kind == "none":
            return y.kind
        if y.kind in ("none", x.kind):
            return x.kind
        if {x.kind, y.kind} == set(NUMBERS):
            return "decimal"
        raise StaticError(f"{x.kind} and {y.kind} do not agree")

    def same_kind(self, x: Val, y: Val) -> None:
        kinds = {x.kind, y.kind}
        if "none" in kinds or len(kinds) == 1 or kinds == set(NUMBERS):
            return
        refs = [k for k in kinds if k.startswith("ref:")]
        if len(refs) == 2:
            raise StaticError(f"{x.kind} and {y.kind} are not compared")
        if refs or kinds <= {"text", "uuid", "enum"}:
            return
        raise StaticError(f"{x.kind} and {y.kind} are not compared")

    def comparable(self, v: Val, key: Field, shape: Shape) -> None:
        if v.kind.startswith("ref:") and v.kind != f"ref:{shape.relation}":
            raise StaticError(f"{v.kind} does not select from {shape.relation}")


def _conjuncts(node: Node) -> list[Node]:
    """The parts of a condition, unless one may fail where an earlier one does not hold."""
    if node.op == "group":
        return _conjuncts(node[0])
    if node.op == "binary" and node[0] == "&&" and not _may_fail(node):
        return _conjuncts(node[1]) + _conjuncts(node[2])
    return [node]


def _may_fail(node) -> bool:
    if isinstance(node, Node):
        return node.op == "call" or (node.op == "binary" and node[0] in "/%") or any(_may_fail(a) for a in node.args)
    return isinstance(node, tuple) and any(_may_fail(a) for a in node)


def _days(period: Column, unit: str, times_: int) -> Column:
    return F.regexp_extract(period, rf"^P(\d+){unit}$", 1).try_cast("long") * times_


def _hours(period: Column) -> Column:
    return F.regexp_extract(period, r"^PT(\d+)H$", 1).try_cast("long") * 3_600_000_000


def _compared(x: Column, y: Column, down: list[bool]) -> Column:
    """-1, 0 or 1 by the parts s0, s1, … of two records, each upwards or downwards."""
    out = None
    for i, d in enumerate(down):
        p, q = (y, x) if d else (x, y)
        for test, sign in ((p[f"s{i}"] < q[f"s{i}"], -1), (p[f"s{i}"] > q[f"s{i}"], 1)):
            out = F.when(test, sign) if out is None else out.when(test, sign)
    return out.otherwise(0)


def _column_name(v: Val) -> str:
    return v.col._jc.toString()


def _reads(node, name: str) -> bool:
    if isinstance(node, Node):
        return (node.op == "name" and node[0] == name) or any(_reads(a, name) for a in node.args)
    return isinstance(node, tuple) and any(_reads(a, name) for a in node)
