"""Defaults, normalisation and what a transition must not violate.

Every rule is a query for violations that must be empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import true
from .project import Output, Scope

REASONS = ("assertion", "check", "duplicate_key", "dangling_ref", "uniqueness", "type_error", "missing_target", "restricted", "evaluation", "malformed", "host", "compatibility", "unsupported")


@dataclass
class Rejection(Exception):
    """Why a transition is not admitted, and where."""

    reason: str
    path: str
    rows: list | None = None

    def __str__(self) -> str:
        return f"{self.reason} at {self.path}"


def with_defaults(df: DataFrame, defaults: Mapping[str, Output], supplied: Mapping[str, Column]) -> DataFrame:
    """Fills fields that were not supplied; an explicit none stays none.

    Defaults may read other fields, whose defaults come first.
    """
    outputs = {name: (lambda s, n=name: F.when(supplied.get(n, F.lit(False)), F.col(n)).otherwise(defaults[n] if isinstance(defaults[n], Column) else defaults[n](s))) for name in defaults}
    scope = Scope([c for c in df.columns if c not in defaults], outputs)
    return df.withColumns({name: scope.output(name) for name in defaults})


def normalised(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(rules))


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    return df.where(~true(check))


def reference_violations(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference, or a member of whose set of references, names no row."""
    many = df.schema[ref].dataType.typeName() == "array"
    probe = df.withColumn("__ref", F.explode(F.col(ref)) if many else F.col(ref)).where("__ref IS NOT NULL")
    return probe.join(target.select(F.col(key).alias("__key")), F.col("__ref") == F.col("__key"), "left_anti").drop("__ref")


def unique_violations(df: DataFrame, key: Iterable[str], scope: Iterable[str] = ()) -> DataFrame:
    """(scope, key, rows) of candidate keys that several rows of a scope share; keys with none are exempt."""
    key, scope = list(key), list(scope)
    full = df.dropna(subset=key)
    return full.groupBy(*scope, *key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def empty_keys(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Rows with a key component that is none, or an empty text or byte string."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
        if df.schema[k].dataType.typeName() in ("string", "binary"):
            bad = bad | (F.octet_length(k) == 0)
    return df.where(bad)


def rejected(violations: DataFrame, reason: str, path: str) -> None:
    """Raises if there are any, with a few of them."""
    if rows := violations.limit(5).collect():
        raise Rejection(reason, path, rows)


def occurrence(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
