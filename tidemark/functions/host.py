"""Functions that a host adds: typed, named ``namespace.function``, and allowed only where their effect is.

A pure function may stand anywhere.  One that verifies or generates (reads a
clock, a key, a random source) may stand only in mutations and defaults, never
in a view, which must give the same again.  Arguments are checked before a
plan is made, results against the declared type where they are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StringType

EFFECTS = ("pure", "verifier", "generated")
POSITIONS = ("view", "default", "mutation")
_CHECKS = {StringType: str, LongType: int, BooleanType: bool}


class HostError(Exception):
    """What is wrong with a host function or its use."""


@dataclass(frozen=True)
class HostFunction:
    name: str
    parameters: tuple[str, ...]
    result: DataType
    body: Callable
    effect: str = "pure"
    contract: str = "1.0.0"


@dataclass
class Registry:
    functions: dict[str, HostFunction] = field(default_factory=dict)

    def register(self, name: str, parameters: Sequence[str], result: DataType, body: Callable, effect: str = "pure", contract: str = "1.0.0") -> None:
        """``body`` takes pandas Series, one for each parameter, and gives one; it runs in Arrow batches."""
        if effect not in EFFECTS:
            raise HostError(f"no effect {effect}")
        if "." not in name or name in self.functions:
            raise HostError(f"{name} cannot be registered")
        self.functions[name] = HostFunction(name, tuple(parameters), result, body, effect, contract)

    def resolve(self, name: str, major: int | None = None) -> HostFunction:
        f = self.functions.get(name)
        if f is None:
            raise HostError(f"unknown function {name}")
        if major is not None and int(f.contract.split(".")[0]) != major:
            raise HostError(f"{name} has contract {f.contract}")
        return f

    def call(self, name: str, args: Sequence[tuple[Column, str]], position: str = "view") -> Column:
        """A call with typed arguments as a Column."""
        f = self.resolve(name)
        if position == "view" and f.effect != "pure":
            raise HostError(f"{name} may not stand in a view")
        kinds = tuple(k for _, k in args)
        if kinds != f.parameters:
            raise HostError(f"{name} takes {f.parameters}, not {kinds}")
        udf = F.pandas_udf(_checked(f), f.result)
        udf = udf if f.effect == "pure" else udf.asNondeterministic()
        return udf(*[c for c, _ in args]) if args else udf(F.lit(0))


def _checked(f: HostFunction):
    """The body with its results held against the declared type."""
    body, name, kind, no_arguments = f.body, f.name, _CHECKS.get(type(f.result)), not f.parameters

    def run(*args: pd.Series) -> pd.Series:
        out = body(len(args[0])) if no_arguments else body(*args)
        if len(out) != len(args[0]):
            raise ValueError(f"{name} gave {len(out)} values for {len(args[0])} rows")
        if kind is not None and any(v is not None and not (isinstance(v, float) and v != v) and not isinstance(v, kind) for v in out.tolist()):
            raise ValueError(f"{name} gave a value of another type")
        return out

    # the number of parameters must be plain to Spark
    return {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[max(1, len(f.parameters))]
