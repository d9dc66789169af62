"""An application's state: load a package, read views, call mutations, go back in time.

State is one DataFrame for each declared collection, with the keys of its
ancestors as columns.  A call computes new frames, checks them against every
declared rule, and commits them as the next serial position, or leaves no trace.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.host import Registry
from .functions.logic import true
from .operators import changes, constraints, deletion
from .operators.constraints import Rejection
from .plans.compile import Compiler, Ctx, Rel, Row, Val, fresh
from .plans.language import Node, parse_statement
from .plans.model import Field, Model, Shape
from .plans.view import StaticError
from .sources.hjson import read
from .sources.scratch import materialize


def from_wire(value: Any, f: Field) -> Any:
    """A value as documents write it: numbers and instants as texts."""
    if value is None:
        return None
    kind = f.labels[0] if f.kind.startswith("ref:") else f.kind
    if kind == "struct":
        return {n: from_wire(value.get(n), m) for n, m in f.members.items()}
    if kind == "set":
        return sorted({from_wire(v, f.element) for v in value})
    if kind == "int":
        return int(value)
    if kind == "decimal":
        return Decimal(str(value))
    if kind == "timestamp":
        return datetime.fromtimestamp(0, UTC) + _micros(int(value)) if not isinstance(value, datetime) else value
    if kind == "duration" and isinstance(value, str):
        from .functions.times import duration

        return duration(value)
    if kind == "json":
        import json

        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if kind == "enum" and value not in f.labels:
        raise Rejection("type_error", value)
    if kind in ("text", "uuid") and not isinstance(value, str):
        raise Rejection("type_error", str(value))
    return value


def _micros(n: int):
    from datetime import timedelta

    return timedelta(microseconds=n)


def to_wire(value: Any) -> Any:
    """Rows as clients see them: numbers and instants as texts, none left out."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, Decimal):
        out = format(value.normalize(), "f")
        return "0" if out in ("-0", "") else out
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=UTC)
        return str((value - datetime(1970, 1, 1, tzinfo=UTC)) // _micros(1))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dict):
        return {k: to_wire(v) for k, v in value.items() if v is not None}
    if isinstance(value, T.Row):
        return to_wire(value.asDict())
    if isinstance(value, list | tuple):
        return [to_wire(v) for v in value]
    return value


@dataclass
class Result:
    status: str
    value: Any = None


class Engine:
    def __init__(self, spark: SparkSession, model: Model, frames: dict[tuple, DataFrame], now: datetime, hosts: Registry | None = None):
        self.spark, self.model, self.now, self.hosts = spark, model, now, hosts or Registry()
        self.history: list[dict[tuple, DataFrame]] = [frames]
        self.requests = 0

    @classmethod
    def load(cls, spark: SparkSession, package: str | Mapping, now: datetime = datetime(2026, 1, 1, tzinfo=UTC), tables: Mapping[str, DataFrame] | None = None, hosts: Registry | None = None) -> Engine:
        """Checks a package and loads its seed; ``tables`` gives root collections' rows as frames instead, ``hosts`` adds functions."""
        package = read(package) if isinstance(package, str) else package
        model = Model(package)
        frames = {s.path: spark.createDataFrame([], s.schema()) for s in model.shapes() if s.path}
        frames[()] = spark.createDataFrame([tuple(None for _ in model.root.stored())], model.root.schema()) if model.root.stored() else spark.range(1).select(F.lit(1).alias("__root"))
        engine = cls(spark, model, frames, now, hosts)
        engine.check_static()
        state = dict(frames)
        for name, df in (tables or {}).items():
            state[(name,)] = df.select(*[F.col(f.name).cast(f.dataType) for f in model.find((name,)).schema()])
        rows: dict[tuple, list] = {}
        _seed_rows(model.root, model.seed, (), rows)
        for path, given in rows.items():
            shape = model.find(path)
            state[path] = engine.with_rows(state, shape, given)
        if model.root.stored():
            given = {n: from_wire(v, model.root.fields[n]) for n, v in model.seed.items() if n in model.root.fields}
            state[()] = engine.complete(state, model.root, spark.createDataFrame([tuple(given.get(n) for n in model.root.stored())], model.root.schema()), [set(given)])
        engine.validate(state)
        engine.history = [state]
        return engine

    # reads

    @property
    def head(self) -> int:
        return len(self.history) - 1

    def at(self, seq: int) -> Engine:
        """The state after an earlier position."""
        return Engine(self.spark, self.model, self.history[seq], self.now, self.hosts)

    def advance(self, duration: str) -> None:
        """Moves the clock; what was active before may be so no more."""
        from .functions.times import duration as micros

        self.now = self.now + _micros(micros(duration))

    def manifest(self) -> dict[str, Any]:
        """What the package offers: views with their parameters, calls, the head position."""
        return {"views": {n: {p: f.kind + "?" * f.optional for p, f in self.model.params.get(n, {}).items()} for n in self.model.public}, "calls": sorted(self.model.calls), "head": self.head}

    def compiler(self, frames: Mapping[tuple, DataFrame], params: Mapping[str, Val] | None = None, position: str = "view") -> Compiler:
        self.requests += 1
        return Compiler(self.model, frames, params or {}, F.lit(self.now).cast("timestamp"), self.model.rounding, self.hosts, position, f"{self.head}.{self.requests}")

    def check_static(self) -> None:
        """Compiles all public views once, so that what is wrong with them is known before any row is read."""
        for name, node in self.model.public.items():
            params = {p: Val(F.lit(None).cast(f.type), f.kind, f.optional) for p, f in self.model.params.get(name, {}).items()}
            self.compiled(self.compiler(self.history[0], params), node)
        self.dependencies()

    def dependencies(self) -> None:
        """Defaults must not read each other in a circle."""
        for shape in self.model.shapes():
            reads = {n: {m for m in shape.fields if f.default is not None and _mentions(f.default, m)} for n, f in shape.fields.items()}
            for start in reads:
                seen, todo = set(), list(reads[start])
                while todo:
                    n = todo.pop()
                    if n == start:
                        raise StaticError(f"the default of {start} reads itself")
                    if n not in seen:
                        seen.add(n)
                        todo += reads[n]

    def compiled(self, c: Compiler, node: Node) -> tuple[str, Rel | Val, DataFrame]:
        rel = c.try_view(node, c.top)
        if rel is not None:
            rel = c.closed(c.whole(rel), c.top)
            return ("record" if rel.single else "rows"), rel, rel.df
        v = c.scalar(node, c.top)
        return "scalar", v, c.top.df

    def frame(self, name: str, **params) -> DataFrame:
        """A public view as a DataFrame in its order."""
        kind, got, df = self._view(name, params)
        if kind == "scalar":
            return df.select(got.col.alias("value"))
        return self._delivered(got)

    def _delivered(self, rel: Rel) -> DataFrame:
        c = self.compiler(self.history[-1])
        df = rel.df.orderBy(*c.ordering(rel)) if not rel.single else rel.df
        df = df.offset(rel.skip) if rel.skip else df
        df = df.limit(rel.limit) if rel.limit is not None else df
        return df.select(*[F.col(x).alias(n) for n, x in rel.outs])

    def _view(self, name: str, params: Mapping):
        if name not in self.model.public:
            raise StaticError(f"no view {name}")
        declared = self.model.params.get(name, {})
        if unknown := set(params) - set(declared):
            raise StaticError(f"unknown parameter {sorted(unknown)[0]}")
        bound = {p: Val(F.lit(from_wire(params.get(p), f)).cast(f.type), f.kind, f.optional) for p, f in declared.items()}
        return self.compiled(self.compiler(self.history[-1], bound), self.model.public[name])

    def view(self, name: str, **params) -> Any:
        """A public view as clients see it."""
        kind, got, df = self._view(name, params)
        return self._shown(kind, got, df)

    def query(self, text: str, **params) -> Any:
        """Any expression over the state."""
        from .plans.language import parse

        c = self.compiler(self.history[-1], {p: _literal(v) for p, v in params.items()})
        return self._shown(*self.compiled(c, parse(text)))

    def _shown(self, kind: str, got, df: DataFrame) -> Any:
        if kind == "scalar":
            return to_wire(df.select(got.col.alias("value")).first()[0])
        rows = [to_wire(r.asDict()) for r in self._delivered(got).collect()]
        return rows[0] if kind == "record" else rows

    # transitions

    def call(self, name: str, **args) -> Result:
        """Runs a public mutation; its effects are admitted as a whole or not at all."""
        program = self.model.calls.get(name)
        if program is None:
            raise StaticError(f"no mutation {name}")
        program = self.expanded(program)
        if not program:
            raise StaticError("a mutation has statements")
        run = _Run(self, {p: _literal(v) for p, v in args.items()})
        value, ended = None, False
        for text in program:
            if ended:
                raise StaticError("return comes last")
            s = parse_statement(text)
            if s.op == "return":
                run.settle()
                value, ended = run.read(s[0]), True
            else:
                run.statement(s)
        run.settle()
        if not run.changed():
            return Result("unchanged", value)
        self.history.append({k: materialize(v, "state") if k in run.touched else v for k, v in run.state.items()})
        return Result("ok", value)

    def expanded(self, program: list[str]) -> list[str]:
        """A program that names another one of the root runs that."""
        if len(program) == 1:
            s = parse_statement(program[0])
            if s.op == "bare" and s[0].op == "current" and s[0][0] in self.model.root.mutations:
                return self.expanded(self.model.root.mutations[s[0][0]])
        return program

    def with_rows(self, state: Mapping[tuple, DataFrame], shape: Shape, rows: list[dict]) -> DataFrame:
        """The collection with more rows, completed by defaults."""
        names = [f.name for f in shape.schema()]
        supplied = [set(r) for r in rows]
        new = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], shape.schema())
        return state[shape.path].unionByName(self.complete(state, shape, new, supplied))

    def complete(self, state: Mapping[tuple, DataFrame], shape: Shape, new: DataFrame, supplied: list[set[str]]) -> DataFrame:
        """Defaults for fields that no row supplied, in the order in which they read each other, then normalisation."""
        c = self.compiler({**state, shape.path: new} if shape.path else {**state, (): new}, position="default")
        everywhere = set.intersection(*supplied) if supplied else set()
        columns = {f.name: Val(F.col(f.name), shape.fields[f.name].kind if f.name in shape.fields else "text", True) for f in shape.schema()}
        for n, f in shape.fields.items():
            if n in columns and not f.optional:
                columns[n] = replace(columns[n], optional=False, decl=f)
        row = Row(columns, shape, shape.ids())
        # new rows may have no key yet: their number tells their identities apart
        ctx = Ctx(new.withColumn("__row", F.monotonically_increasing_id()), row, {}, ["__row"])
        done: set[str] = set()

        def fill(n: str) -> None:
            if n in done:
                return
            done.add(n)
            f = shape.fields[n]
            if f.default is None or n in everywhere:
                return
            for m in shape.fields:
                if _mentions(f.default, m):
                    fill(m)
            v = c.scalar(f.default, ctx)
            ctx.df = ctx.df.withColumn(n, F.coalesce(F.col(n), v.col.cast(f.type)))

        for n in shape.stored():
            fill(n)
        for n in shape.stored():
            if shape.fields[n].normalize is not None:
                inner = Ctx(ctx.df, Row({**columns, "value": columns[n]}, shape, shape.ids()), {}, shape.ids())
                v = c.scalar(shape.fields[n].normalize, inner)
                ctx.df = inner.df.withColumn(n, v.col)
        names = [f.name for f in shape.schema()]
        return ctx.df.select(*names) if names else ctx.df

    def validate(self, state: Mapping[tuple, DataFrame], touched: set[tuple] | None = None) -> None:
        """Every declared rule as a query for violations, over the collections that changed."""
        touched = set(state) if touched is None else touched
        for shape in self.model.shapes():
            df = state[shape.path]
            if shape.path and shape.path in touched:
                constraints.rejected(constraints.empty_keys(df, shape.key), "check", f"{shape.relation}.$key")
                ids = shape.ids()
                constraints.rejected(constraints.unique_violations(df, ids), "duplicate_key", shape.relation)
                for u in shape.unique:
                    constraints.rejected(constraints.unique_violations(df, u, shape.ancestors()), "uniqueness", f"{shape.relation}.{','.join(u)}")
            for n in shape.stored():
                f = shape.fields[n]
                if shape.path in touched and not f.optional and f.kind != "struct":
                    constraints.rejected(df.where(F.col(n).isNull()), "check", f"{shape.relation}.{n}")
                for g in (f, f.element):
                    if g is not None and g.ref is not None and (shape.path in touched or g.ref in touched):
                        target = self.model.find(g.ref)
                        constraints.rejected(constraints.reference_violations(df, n, state[g.ref], target.key[0]), "dangling_ref", f"{shape.relation}.{n}")
            if shape.path in touched:
                self.checks(state, shape)

    def checks(self, state: Mapping[tuple, DataFrame], shape: Shape) -> None:
        c = self.compiler(state)
        rel = c.scan(shape) if "$source" not in shape.bucket else None
        if rel is None:
            return
        tests = [(x, None) for x in shape.checks] + [(f.check, n) for n, f in shape.fields.items() if f.check is not None]
        for test, n in tests:
            ctx = Ctx(rel.df, Row({**rel.cur.columns, **({"value": rel.cur.columns[n]} if n else {})}, shape, rel.ids), {}, rel.ids)
            holds = c.boolean(c.scalar(test, ctx))
            bad = ctx.df.where(~true(holds)) if n is None else ctx.df.where(rel.cur.columns[n].col.isNotNull() & ~true(holds))
            constraints.rejected(bad, "check", f"{shape.relation}{'.' + n if n else ''}")
        if shape.bucket and rel.cur.structural:
            a, b = rel.cur.structural["from"].col, rel.cur.structural["until"].col
            constraints.rejected(rel.df.where(b.isNotNull() & (b <= a)), "check", f"{shape.relation}.$bucket")


class _Run:
    """A program's prospective state: every statement sees what the ones before it did."""

    def __init__(self, engine: Engine, params: dict[str, Val]):
        self.engine, self.model, self.params = engine, engine.model, params
        self.before = engine.history[-1]
        self.state, self.touched, self.locals, self.checked = dict(self.before), set(), {}, True

    def compiler(self) -> Compiler:
        c = self.engine.compiler(self.state, self.params, "mutation")
        for name, (shape, key) in self.locals.items():
            rel = c.scan(shape)
            own = rel.ids[-len(shape.key) :]
            on = [F.col(i).eqNullSafe(F.lit(k)) for i, k in zip(own, key, strict=True)]
            rel.df = rel.df.where(on[0]) if len(on) == 1 else rel.df.where(on[0] & on[1])
            c.locals[name] = rel
        return c

    def settle(self) -> None:
        """Checks what changed since the last time."""
        if not self.checked:
            self.engine.validate(self.state, self.touched)
            self.checked = True

    def changed(self) -> bool:
        for path in self.touched:
            shape = self.model.find(path)
            if not changes.unchanged(changes.diff(self.before[path], self.state[path], shape.ids() or [])) if path else self.before[()].collect() != self.state[()].collect():
                return True
        return False

    def read(self, node: Node) -> Any:
        c = self.compiler()
        if node.op == "block" and node[0].op == "name" and node[0][0] in self.locals:
            kind, got, df = self.engine.compiled(c, node)
            rows = self.engine._shown(kind, got, df)
            return rows[0] if rows else None
        return self.engine._shown(*self.engine.compiled(c, node))

    def put(self, path: tuple, df: DataFrame) -> None:
        self.state[path] = df
        self.touched.add(path)
        self.checked = False

    def statement(self, s: Node) -> None:
        if s.op == "bare":
            self.bare(s[0])
        elif s.op == "assign":
            self.assign(s[0], s[1])
        elif s.op == "clear":
            self.assign(s[0], Node("none"))

    def bare(self, node: Node, local: str | None = None) -> None:
        if node.op == "binary" and node[0] in "+-" and (shape := self.collection(node[1])) is not None:
            return self.insert(shape, node[1], node[2], local) if node[0] == "+" else self.delete(shape, node[2])
        if node.op == "binary" and node[0] in "+-":
            return self.assign(node[1], node, of_set=node[0])
        if node.op == "unary" and node[0] == "-":
            return self.delete_view(node[1])
        if node.op == "block":
            return self.patch(node[0], node[1])
        if node.op == "call" and node[0].op == "name" and node[0][0] == "assert":
            c = self.compiler()
            test = c.scalar(node[1][0], c.top)
            if not c.top.df.select(true(test.col)).first()[0]:
                raise Rejection("assertion", node[1][1][0] if len(node[1]) > 1 else "assertion")
            return None
        if node.op == "current" and node[0] in self.model.root.mutations:
            for text in self.model.root.mutations[node[0]]:
                self.statement(parse_statement(text))
            return None
        raise StaticError(f"not a statement: {node.op}")

    def collection(self, node: Node) -> Shape | None:
        """The collection that a plain path, or a nested one behind a selector, names."""
        if node.op in ("current", "root") and node[0] in self.model.root.children:
            return self.model.root.children[node[0]]
        if node.op == "member" and node[0].op == "select":
            up = self.collection(node[0][0])
            return up.children.get(node[1]) if up is not None else None
        return None

    def ancestors_of(self, node: Node) -> dict[str, Any]:
        """Key columns that selectors on the way fix."""
        if node.op != "member":
            return {}
        up = self.collection(node[0][0])
        c = self.compiler()
        keys = [c.top.df.select(c.scalar(k, c.top).col).first()[0] for k in node[0][1].args]
        out = self.ancestors_of(node[0][0]) | {up.column(k): v for k, v in zip(up.key, keys, strict=True)}
        there = self.state[up.path]
        for k, v in zip(up.key, keys, strict=True):
            there = there.where(F.col(k) == F.lit(v))
        if there.isEmpty():
            raise Rejection("missing_target", up.relation)
        return out

    def insert(self, shape: Shape, target: Node, what: Node, local: str | None) -> None:
        fixed = self.ancestors_of(target)
        c = self.compiler()
        rel = c.try_view(what, c.top) if what.op != "object" else None
        if rel is not None:
            rel = c.closed(c.whole(rel), c.top)
            given = {n for n, _ in rel.outs}
            new = rel.df.select(*[(F.col(dict(rel.outs)[f.name]) if f.name in given else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in shape.schema()])
            new = self.engine.complete(self.state, shape, new, [given])
        else:
            ctx = c.top
            values, nested = {}, {}
            for m in what.args:
                name, node = (m[0], m[1]) if m.op == "output" else (m[0][0], m[0])
                if name in shape.children:
                    nested[name] = node
                elif name not in shape.fields or shape.fields[name].computed is not None:
                    raise StaticError(f"unknown field {name}")
                else:
                    values[name] = c.scalar(node, ctx)
            row = ctx.df.select(*[(values[f.name].col if f.name in values else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in shape.schema()])
            new = materialize(self.engine.complete(self.state, shape, row, [set(values)]), "row")
            if local:
                self.locals[local] = (shape, list(new.select(*shape.key).first()))
            for name, node in nested.items():
                child = shape.children[name]
                rel = c.closed(c.whole(c.view(node, c.top)), c.top)
                key = new.select(*[F.col(k).alias(shape.column(k)) for k in shape.key])
                outs = dict(rel.outs)
                kids = rel.df.select(*[F.col(x).alias(n) for n, x in outs.items()]).join(F.broadcast(key), F.lit(True)) if not key.isEmpty() else None
                kids = kids.select(*[(F.col(f.name) if f.name in (*outs, *key.columns) else F.lit(fixed.get(f.name))).cast(f.dataType).alias(f.name) for f in child.schema()])
                self.put(child.path, self.state[child.path].unionByName(self.engine.complete(self.state, child, kids, [set(outs)])))
        self.put(shape.path, self.state[shape.path].unionByName(new))
        self.settle()

    def delete(self, shape: Shape, keys: Node) -> None:
        c = self.compiler()
        v = c.scalar(keys, c.top)
        key = c.top.df.select((F.explode(v.col) if v.kind == "set" else v.col).cast(shape.fields[shape.key[0]].type).alias(shape.key[0]))
        self.remove(shape, key)

    def delete_view(self, node: Node) -> None:
        c = self.compiler()
        rel = c.closed(c.view(node, c.top), c.top)
        shape = rel.cur.shape
        self.remove(shape, rel.df.select(*[F.col(x).alias(n) for x, n in zip(rel.ids, shape.ids(), strict=True)]))

    def remove(self, shape: Shape, keys: DataFrame) -> None:
        """Deletes rows, their nested rows, and what follows by the references' policies."""
        keys = materialize(keys, "keys")
        text = lambda x: x.cast("string")
        edges = None
        for s in self.model.shapes():
            for n in s.stored():
                for g in (s.fields[n], s.fields[n].element):
                    if g is not None and g.ref is not None:
                        own = F.concat_ws("\x1f", *[text(F.col(i)) for i in s.ids()]).alias("__own")
                        ref = F.transform(n, text) if s.fields[n].kind == "set" else text(F.col(n))
                        frame = self.state[s.path].select(own, ref.alias(n))
                        policy = g.on_delete if isinstance(g.on_delete, str) else None
                        policy = {None: "restrict", "none": "clear", "remove": "drop_member"}.get(policy, policy)
                        e = deletion.references(frame, s.relation, "__own", n, self.model.find(g.ref).relation, policy)
                        edges = e if edges is None else edges.unionByName(e)
        doomed = keys.select(F.lit(shape.relation).alias("kind"), F.concat_ws("\x1f", *[text(F.col(k)) for k in keys.columns]).alias("id"))
        if edges is not None:
            edges = materialize(edges, "edges")
            doomed = deletion.doomed(doomed, edges)
            constraints.rejected(deletion.restricted(doomed, edges), "restricted", shape.relation)
            for e in deletion.cleared(doomed, edges).select("to_kind", "field").distinct().collect():
                s = self.model.find(tuple(e["to_kind"].strip("/").split("/")))
                target = self.model.find(s.fields[e["field"]].ref).relation
                gone = doomed.where(F.col("kind") == target).select(F.col("id").alias("__gone"))
                df = self.state[s.path].join(gone, text(F.col(e["field"])) == F.col("__gone"), "left")
                self.put(s.path, df.withColumn(e["field"], F.when(F.col("__gone").isNull(), F.col(e["field"]))).drop("__gone"))
        for s in self.model.shapes():
            if not s.path:
                continue
            up = s
            while up is not None and up.path:
                n = len(up.ids())
                gone = doomed.where(F.col("kind") == up.relation).select(F.col("id").alias("__gone"))
                prefix = F.concat_ws("\x1f", *[text(F.col(i)) for i in s.ids()[:n]])
                if not gone.isEmpty():
                    self.put(s.path, self.state[s.path].join(gone, prefix == F.col("__gone"), "left_anti"))
                up = up.above
        self.settle()

    def assign(self, target: Node, value: Node, of_set: str | None = None) -> None:
        if target.op == "name" and of_set is None and value.op != "none":
            return self.bare(value, local=target[0])
        if target.op == "current" and target[0] in self.model.root.children:
            return self.replace_rows(self.model.root.children[target[0]], value)
        if target.op == "current" and target[0] in self.model.root.fields:
            return self.update_root(target[0], value, of_set)
        if target.op == "member":
            return self.patch(target[0], (Node("set", (target[1], value)),), of_set)
        raise StaticError(f"nothing to assign to: {target.op}")

    def replace_rows(self, shape: Shape, value: Node) -> None:
        """A collection becomes the rows of a view; nested rows of keys that stay, stay."""
        c = self.compiler()
        rel = c.closed(c.whole(c.view(value, c.top)), c.top)
        outs = dict(rel.outs)
        if unknown := set(outs) - set(shape.stored()):
            raise StaticError(f"unknown field {sorted(unknown)[0]}")
        new = rel.df.select(*[(F.col(outs[f.name]) if f.name in outs else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.schema()])
        new = materialize(self.engine.complete(self.state, shape, new, [set(outs)]), "rows")
        for s in self.model.shapes():
            if s.path[: len(shape.path)] == shape.path and s is not shape:
                keys = new.select(*[F.col(k).alias(shape.column(k)) for k in shape.key])
                self.put(s.path, self.state[s.path].join(keys, keys.columns, "left_semi").select(*self.state[s.path].columns))
        self.put(shape.path, new)
        self.settle()

    def update_root(self, name: str, value: Node, of_set: str | None) -> None:
        c = self.compiler()
        ctx = Ctx(c.top.df, c.top.cur, {}, [])
        v = c.scalar(value[2] if of_set else value, c.top)
        ctx = c.top
        cur = c.root.cur.columns
        new = v.col
        if of_set:
            new = F.array_sort((F.array_union if of_set == "+" else F.array_except)(cur[name].col, v.col if v.kind == "set" else F.array(v.col)))
        f = self.model.root.fields[name]
        df = ctx.df.select(*[(new.cast(f.type) if n == name else cur[n].col).alias(n) for n in self.model.root.stored()])
        self.put((), df)
        self.settle()

    def patch(self, target: Node, members: tuple[Node, ...], of_set: str | None = None) -> None:
        """Sets fields of the selected rows; right sides read the rows before."""
        c = self.compiler()
        rel = c.closed(c.view(target, c.top), c.top)
        shape = rel.cur.shape
        if shape is None or not shape.path:
            for m in members:
                self.update_root(m[0], m[1], of_set)
            return
        ctx = Ctx(rel.df, rel.cur, rel.rows, rel.ids)
        new: dict[str, Column] = {}
        for m in members:
            name = m[0]
            if name not in shape.fields or shape.fields[name].computed is not None:
                raise StaticError(f"unknown field {name}")
            if m.op == "unset":
                new[name] = F.lit(None)
            elif of_set:
                v = c.scalar(m[1][2], ctx)
                new[name] = F.array_sort((F.array_union if of_set == "+" else F.array_except)(rel.cur.columns[name].col, v.col if v.kind == "set" else F.array(v.col)))
            else:
                new[name] = c.scalar(m[1], ctx).col
        made = {n: fresh(n) for n in new}
        hit = ctx.df.select(*[F.col(x).alias(f"__h{i}") for i, x in enumerate(rel.ids)], *[x.cast(shape.fields[n].type).alias(made[n]) for n, x in new.items()], F.lit(True).alias("__hit")).dropDuplicates([f"__h{i}" for i in range(len(rel.ids))])
        df = self.state[shape.path]
        if set(new) & set(shape.key):
            self.rekey(shape, hit, made)
            return
        on = [F.col(i).eqNullSafe(F.col(f"__h{k}")) for k, i in enumerate(shape.ids())]
        df = df.join(hit, on, "left")
        df = df.select(*[(F.when(true(F.col("__hit")), F.col(made[f.name])).otherwise(F.col(f.name)) if f.name in made else F.col(f.name)).alias(f.name) for f in shape.schema()])
        self.put(shape.path, df)
        self.settle()

    def rekey(self, shape: Shape, hit: DataFrame, made: dict[str, str]) -> None:
        """New keys; nested rows and references follow."""
        if len(shape.key) != 1 or shape.ancestors():
            raise StaticError("a key of one field at the root is renamed")
        key = shape.key[0]
        renamed = materialize(hit.select(F.col("__h0").alias("old"), F.col(made[key]).alias("new")), "renamed")
        followers = {}
        for s in self.model.shapes():
            for n in [f.name for f in s.schema()]:
                is_ref = n in s.fields and s.fields[n].ref == shape.path
                if is_ref or (n == shape.column(key) and s.path[: len(shape.path)] == shape.path):
                    followers[s.path, n] = (self.state[s.path], n)
        rows, followed = changes.rekey(self.state[shape.path], key, renamed, {k: v for k, v in followers.items()})
        self.put(shape.path, rows)
        for (path, _), df in followed.items():
            self.put(path, df)
        self.settle()


def _seed_rows(shape: Shape, data: Mapping, above: tuple, out: dict[tuple, list]) -> None:
    """Rows of a seed: collections are objects of key text to fields."""
    for name, child in shape.children.items():
        for key, fields in data.get(name, {}).items():
            row = dict(zip(child.ancestors(), above, strict=True))
            parts = [key] if len(child.key) == 1 else key.split(":")
            own = [from_wire(p, child.fields[k]) for k, p in zip(child.key, parts, strict=True)]
            row |= dict(zip(child.key, own, strict=True))
            row |= {n: from_wire(v, child.fields[n]) for n, v in fields.items() if n in child.fields}
            out.setdefault(child.path, []).append(row)
            _seed_rows(child, fields, (*above, *own), out)


def _mentions(node, name: str) -> bool:
    if isinstance(node, Node):
        return (node.op in ("name", "current") and node[0] == name) or any(_mentions(a, name) for a in node.args)
    return isinstance(node, tuple) and any(_mentions(a, name) for a in node)


def _literal(v: Any) -> Val:
    if isinstance(v, bool):
        return Val(F.lit(v), "bool")
    if isinstance(v, int):
        return Val(F.lit(v).cast("long"), "int")
    if isinstance(v, Decimal):
        return Val(F.lit(v), "decimal")
    if isinstance(v, list):
        return Val(F.array(*[F.lit(x) for x in v]), "set", decl=Field("set", element=Field("text")))
    if isinstance(v, datetime):
        return Val(F.lit(v), "timestamp")
    return Val(F.lit(v), "none" if v is None else "text", v is None)
