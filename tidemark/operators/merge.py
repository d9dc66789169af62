"""Three-way merge, and how two histories relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = ("same_point", "fast_forward", "rollback", "merge", "unrelated")
CONFLICTS = ("incompatible_value", "delete_vs_modify", "competing_insert", "uniqueness")


def relation(ours: list[str], theirs: list[str]) -> str:
    """How their line of points relates to ours, each a list of point ids from the first on."""
    shared = 0
    for a, b in zip(ours, theirs, strict=False):
        if a != b:
            break
        shared += 1
    if ours == theirs:
        return "same_point"
    if not shared:
        return "unrelated"
    if shared == len(ours):
        return "fast_forward"
    return "rollback" if shared == len(theirs) else "merge"


def _three(base: DataFrame, local: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    fields = [c for c in base.columns if c not in key]
    sides = [d.select(*key, *[F.col(f).alias(f"__{s}_{f}") for f in fields], F.lit(True).alias(f"__{s}")) for s, d in (("b", base), ("l", local), ("i", incoming))]
    return sides[0].join(sides[1], key, "full").join(sides[2], key, "full"), fields


def _row(side: str, fields: list[str]) -> Column:
    return F.struct(*[F.col(f"__{side}_{f}").alias(f) for f in fields])


def _cases(fields: list[str]) -> dict[str, Column]:
    b, l, i = (F.col(f"__{s}").isNotNull() for s in "bli")
    l_same, i_same = _row("l", fields).eqNullSafe(_row("b", fields)), _row("i", fields).eqNullSafe(_row("b", fields))
    return {
        "b": b,
        "l": l,
        "i": i,
        "competing": ~b & l & i & ~_row("l", fields).eqNullSafe(_row("i", fields)),
        "deleted_here": b & ~l & i & ~i_same,
        "deleted_there": b & l & ~i & ~l_same,
        "gone": b & (~l | (~i & l_same)),
    }


def _field_conflict(f: str) -> Column:
    b, l, i = (F.col(f"__{s}_{f}") for s in "bli")
    return ~l.eqNullSafe(b) & ~i.eqNullSafe(b) & ~l.eqNullSafe(i)


def conflicts(base: DataFrame, local: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """(key..., field, kind): what both sides changed in different ways; a whole row's field is none."""
    df, fields = _three(base, local, incoming, key)
    c = _cases(fields)
    there = c["b"] & c["l"] & c["i"]
    whole = F.when(c["competing"], F.struct(F.lit(None).cast("string").alias("field"), F.lit("competing_insert").alias("kind"))).when(c["deleted_here"] | c["deleted_there"], F.struct(F.lit(None).cast("string").alias("field"), F.lit("delete_vs_modify").alias("kind")))
    each = [F.when(there & _field_conflict(f), F.struct(F.lit(f).alias("field"), F.lit("incompatible_value").alias("kind"))) for f in fields]
    found = df.select(*key, F.explode(F.array_compact(F.array(whole, *each))).alias("c"))
    return found.select(*key, "c.field", "c.kind")


def merged(base: DataFrame, local: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The merge where nothing conflicts; where something does, the local value (see ``conflicts``)."""
    df, fields = _three(base, local, incoming, key)
    c = _cases(fields)
    values = []
    for f in fields:
        b, l, i = (F.col(f"__{s}_{f}") for s in "bli")
        both = F.when(l.eqNullSafe(b), i).otherwise(l)
        values.append(F.when(c["b"] & c["l"] & c["i"], both).when(c["l"], l).otherwise(i).alias(f))
    return df.where(~c["gone"]).select(*key, *values)
