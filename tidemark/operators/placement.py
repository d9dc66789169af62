"""Where copies of a blob must lie, and key rings: conditions over small sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def satisfied(policy: dict | str, stores: Column) -> Column:
    """Whether the stores that hold a blob satisfy a policy.

    A policy is a store's name, ``{"all": [...]}``, ``{"any": [...]}`` or
    ``{"copies": n, "of": [...]}`` of policies.
    """
    if isinstance(policy, str):
        return F.coalesce(F.array_contains(stores, policy), F.lit(False))
    if "copies" in policy:
        return F.lit(0) + sum((satisfied(p, stores).cast("int") for p in policy["of"]), F.lit(0)) >= policy["copies"]
    parts = [satisfied(p, stores) for p in policy.get("all") or policy["any"]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if "all" in policy else out | p
    return out


def named(policy: dict | str) -> set[str]:
    if isinstance(policy, str):
        return {policy}
    return set().union(*(named(p) for p in policy.get("all") or policy.get("any") or policy["of"]))


def surplus(policy: dict | str, stores: Column) -> Column:
    """Stores that hold a copy which the policy never asks for."""
    return F.array_sort(F.array_except(stores, F.array(*[F.lit(s) for s in sorted(named(policy))])))


def ring_current(versions: DataFrame, ring: str = "ring") -> DataFrame:
    """The version of each key ring that signs: the latest that is not revoked."""
    live = versions.where("revoked_at IS NULL")
    return live.groupBy(ring).agg(F.max_by(F.struct(*[c for c in versions.columns if c != ring]), "version").alias("v")).select(ring, "v.*")


def ring_accepted(versions: DataFrame, instant: Column) -> DataFrame:
    """Versions whose signatures are accepted at the instant."""
    return versions.where((F.col("accepted_from") <= instant) & (F.col("accepted_until").isNull() | (instant < F.col("accepted_until"))) & F.col("revoked_at").isNull())


def ring_public(versions: DataFrame, instant: Column) -> DataFrame:
    """The public halves of accepted versions."""
    return ring_accepted(versions, instant).drop("secret")
