"""Declared models: a package's document becomes shapes with typed fields."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.arith import ROUNDINGS
from .language import Node, parse
from .view import StaticError

#: Declared scalar types and what holds them.
SCALARS = {
    "text": T.StringType(),
    "bool": T.BooleanType(),
    "int": T.LongType(),
    "decimal": T.DecimalType(38, 16),
    "bytes": T.BinaryType(),
    "uuid": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "duration": T.LongType(),
    "period": T.StringType(),
    "json": T.StringType(),
}
NOT_KEYS = ("json", "set", "struct", "period")
_FIELD = re.compile(r"\s*([a-z]+)(\?)?\s*(?:=\s*(.*))?$", re.S)


@dataclass
class Field:
    kind: str
    optional: bool = False
    default: Node | None = None
    computed: Node | None = None
    ref: tuple[str, ...] | None = None
    element: Field | None = None
    labels: tuple[str, ...] = ()
    members: dict[str, Field] = field(default_factory=dict)
    on_delete: str | None = None
    check: Node | None = None
    normalize: Node | None = None

    @property
    def type(self) -> T.DataType:
        if self.kind == "set":
            return T.ArrayType(self.element.type)
        if self.kind == "struct":
            return T.StructType([T.StructField(n, m.type) for n, m in sorted(self.members.items())])
        return SCALARS.get(self.kind, T.StringType())


@dataclass
class Shape:
    path: tuple[str, ...]
    key: list[str] = field(default_factory=list)
    fields: dict[str, Field] = field(default_factory=dict)
    children: dict[str, Shape] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[Node] = field(default_factory=list)
    bucket: dict[str, Node] = field(default_factory=dict)
    views: dict[str, Node] = field(default_factory=dict)
    mutations: dict[str, list[str]] = field(default_factory=dict)
    above: Shape | None = None

    @property
    def relation(self) -> str:
        return "/" + "/".join(self.path)

    def ancestors(self) -> list[str]:
        """Columns of the keys of all collections above, outermost first."""
        out, up = [], self.above
        while up is not None and up.path:
            out = [f"__{'_'.join(up.path)}_{k}" for k in up.key] + out
            up = up.above
        return out

    def ids(self) -> list[str]:
        return [*self.ancestors(), *self.key]

    def column(self, name: str) -> str:
        """The column under which this shape's key field stands in its children."""
        return f"__{'_'.join(self.path)}_{name}"

    def stored(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.computed is None]

    def schema(self) -> T.StructType:
        up, out = self.above, []
        while up is not None and up.path:
            out = [T.StructField(up.column(k), up.fields[k].type) for k in up.key] + out
            up = up.above
        return T.StructType(out + [T.StructField(n, self.fields[n].type) for n in self.stored()])


def _rounding(semantics) -> str:
    """The declared rounding of decimal division; nothing else can be declared."""
    division = semantics.get("decimal_division", {}) if isinstance(semantics, dict) else None
    if not isinstance(division, dict) or set(semantics) - {"decimal_division"} or set(division) - {"rounding"}:
        raise StaticError("$semantics declares decimal_division: { rounding } alone")
    mode = division.get("rounding", "half_up")
    if mode not in ROUNDINGS:
        raise StaticError(f"no rounding mode {mode}")
    return mode


class Model:
    """The root's shape with all collections under it, and the public views and calls."""

    def __init__(self, package: Mapping):
        unknown = [k for k in package if k.startswith("$") and k not in ("$app", "$model", "$data", "$bundle", "$semantics") and package[k] != 1]
        if unknown:
            raise StaticError(f"unknown member {unknown[0]}")
        model = package.get("$model", {})
        self.root = _shape((), model, None, model.get("$types", {}))
        self.public, self.params = {}, {}
        for name, entry in model.get("$public", {}).items():
            if "$view" in entry:
                self.public[name] = parse(entry["$view"])
            self.params[name] = {p: declared(t) for p, t in entry.get("$params", {}).items()}
        self.calls = {f"{name}.{m}": _program(p) for name, entry in model.get("$public", {}).items() for m, p in entry.get("$mut", {}).items()}
        self.seed = package.get("$data", {})
        self.rounding = _rounding(package.get("$semantics", {}))
        self._resolve(self.root)

    def shapes(self) -> list[Shape]:
        out, todo = [], [self.root]
        while todo:
            shape = todo.pop()
            out.append(shape)
            todo += shape.children.values()
        return out

    def find(self, path: tuple[str, ...]) -> Shape:
        shape = self.root
        for p in path:
            if p not in shape.children:
                raise StaticError(f"/{'/'.join(path)} is no collection")
            shape = shape.children[p]
        return shape

    def _resolve(self, shape: Shape) -> None:
        for name, f in shape.fields.items():
            for g in (f, f.element):
                if g is not None and g.ref is not None:
                    target = self.find(g.ref)
                    if len(target.key) != 1:
                        raise StaticError(f"{name} refers to a collection with a key of several fields")
                    g.kind, key = f"ref:{target.relation}", target.fields[target.key[0]]
                    g.labels = (key.kind,)
        for child in shape.children.values():
            self._resolve(child)


def _program(p) -> list[str]:
    return [p] if isinstance(p, str) else list(p)


def declared(text) -> Field:
    """A field from its short text (``"int? = 0"``) or its object form."""
    if isinstance(text, Mapping):
        return _object_field(text, {})
    if text.lstrip().startswith("= "):
        return Field("", computed=parse(text.lstrip()[2:]))
    m = _FIELD.match(text)
    if not m or m[1] not in SCALARS:
        raise StaticError(f"unknown type {text}")
    return Field(m[1], bool(m[2]), parse(m[3]) if m[3] else None)


def _object_field(d: Mapping, types: Mapping) -> Field | None:
    markers = [k for k in ("$ref", "$set", "$enum", "$type") if k in d]
    if len(markers) > 1:
        raise StaticError("a field has one kind")
    out = None
    if "$ref" in d:
        out = Field("ref", ref=tuple(d["$ref"].strip("/").split("/")), on_delete=d.get("$on_delete"))
    elif "$set" in d:
        element = d["$set"]
        inner = Field("ref", ref=tuple(element.strip("/").split("/"))) if isinstance(element, str) and element.startswith("/") else declared(element)
        if inner.optional:
            raise StaticError("a set's elements are not optional")
        out = Field("set", element=inner)
    elif "$enum" in d:
        out = Field("enum", labels=tuple(d["$enum"]))
    elif "$type" in d:
        out = declared(types[d["$type"]] if d["$type"] in types else d["$type"])
    if out is not None:
        out.optional = out.optional or bool(d.get("$optional"))
        default = d.get("$default")
        if default is not None:
            out.default = parse(default[2:]) if isinstance(default, str) and default.startswith("= ") else Node("literal", (default,))
        out.check = parse(d["$check"]) if isinstance(d.get("$check"), str) else None
        out.normalize = parse(d["$normalize"]) if isinstance(d.get("$normalize"), str) else None
    return out


def _shape(path: tuple[str, ...], d: Mapping, above: Shape | None, types: Mapping) -> Shape:
    shape = Shape(path, above=above)
    key = d.get("$key", [])
    shape.key = [key] if isinstance(key, str) else list(key)
    unique = d.get("$unique", [])
    shape.unique = [[u] if isinstance(u, str) else list(u) for u in ([unique] if isinstance(unique, str) else unique)]
    check = d.get("$check", [])
    shape.checks = [parse(x if isinstance(x, str) else x.get("$that", x.get("$expr", "true"))) for x in ([check] if isinstance(check, str | Mapping) else check)]
    shape.mutations = {n: _program(p) for n, p in d.get("$mut", {}).items()}
    bucket = d.get("$bucket")
    if bucket:
        shape.bucket = {k: parse(v) for k, v in bucket.items() if isinstance(v, str)}
    for name, v in d.items():
        if name.startswith("$"):
            continue
        if isinstance(v, Mapping):
            got = _object_field(v, types)
            if got is not None:
                shape.fields[name] = got
            elif "$key" in v or "$bucket" in v:
                shape.children[name] = _shape((*path, name), v, shape, types)
            elif "$view" in v:
                shape.views[name] = parse(v["$view"])
            else:
                shape.fields[name] = Field("struct", members={n: _member(m, types) for n, m in v.items() if not n.startswith("$")})
        elif isinstance(v, str):
            shape.fields[name] = declared(types[v] if isinstance(types.get(v), str) else v)
        else:
            raise StaticError(f"{name} has no type")
    for k in shape.key:
        f = shape.fields.get(k)
        if f is None:
            raise StaticError(f"the key field {k} is missing")
        if f.optional or f.kind in NOT_KEYS:
            raise StaticError(f"{k} cannot be a key")
    return shape


def _member(m, types: Mapping) -> Field:
    if isinstance(m, Mapping):
        return _object_field(m, types) or Field("struct", members={n: _member(x, types) for n, x in m.items() if not n.startswith("$")})
    return declared(m)
