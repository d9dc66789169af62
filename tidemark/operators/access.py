"""Who may see a view: members of a role, by a semi-join, and parameters that are closed."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import functions as F

from ..plans.view import View


class Denied(Exception):
    """The actor is in no role that the view is for."""


def authorise(members: View, actor: Any, field: str = "account") -> None:
    """An error unless the actor is among the members; reads at most one row."""
    if members.bounded().df.where(F.col(field) == F.lit(actor)).limit(1).isEmpty():
        raise Denied(str(actor))


def visible(view: View, grants: View, owner: str, actor: Any, granted: str = "account", scope: str = "scope") -> View:
    """The rows of scopes that the actor is granted."""
    mine = grants.bounded().df.where(F.col(granted) == F.lit(actor)).select(F.col(scope).alias("__scope"))
    view = view.bounded()
    return view.on(view.df.join(mine, F.col(owner) == F.col("__scope"), "left_semi"))


def closed_arguments(declared: Mapping[str, Any], given: Mapping[str, Any]) -> dict[str, Any]:
    """Arguments with defaults filled in; unknown ones and missing ones without a default are errors."""
    if unknown := set(given) - set(declared):
        raise TypeError(f"unknown argument {sorted(unknown)[0]}")
    missing = [n for n, default in declared.items() if default is ... and n not in given]
    if missing:
        raise TypeError(f"missing argument {missing[0]}")
    return {n: given.get(n, default) for n, default in declared.items()}
