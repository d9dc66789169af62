"""A view: rows with an identity and an order, as a lazy DataFrame.

Identity lives in hidden columns ``__id0``, ``__id1``, ... (ancestors' keys,
then the row's own), order in ``__ord0``, ...  Set operators, deltas and
tiebreaks go by identity, never by whole rows.  Order is information until a
sink or a positional operator asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import asc, desc, positioned


class StaticError(Exception):
    """What is wrong with a view before any row is read."""


@dataclass(frozen=True)
class View:
    df: DataFrame
    ids: int
    #: For each order column whether it descends.
    down: tuple[bool, ...] = ()
    #: The identity domain: only views of one domain may be combined.
    relation: str = ""
    #: An endless series, which must be bounded in time before it is read.
    unbounded: bool = False
    #: Rows to leave out and to keep after ordering.
    skip: int = 0
    limit: int | None = None

    @property
    def id_columns(self) -> list[str]:
        return [f"__id{i}" for i in range(self.ids)]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def order(self) -> list[Column]:
        """The sort keys, ending in the identity."""
        keys = [(desc if d else asc)(f"__ord{i}") for i, d in enumerate(self.down)]
        return [*keys, *(asc(c) for c in self.id_columns)]

    def on(self, df: DataFrame, **changes) -> View:
        return replace(self, df=df, **changes)

    def bounded(self) -> View:
        """The view with skip and limit carried out, so that operators above see only its rows."""
        if self.unbounded:
            raise StaticError("an endless series is read only at an instant or between two")
        if not self.skip and self.limit is None:
            return self
        df = self.df.orderBy(*self.order())
        if self.skip:
            df = df.offset(self.skip)
        if self.limit is not None:
            df = df.limit(self.limit)
        return self.on(df, skip=0, limit=None)

    def rows(self) -> DataFrame:
        """The fields of all rows, in no order."""
        return self.bounded().df.select(*self.fields)

    def delivered(self) -> DataFrame:
        """The fields of all rows, in the view's order."""
        view = self.bounded()
        return view.df.orderBy(*view.order()).select(*self.fields)

    def positions(self, name: str = "pos") -> DataFrame:
        """The fields with each row's position from 1; top-k where the view is limited."""
        if self.unbounded:
            raise StaticError("an endless series is read only at an instant or between two")
        if self.limit is not None:
            end = self.skip + self.limit
            out = positioned(self.df, self.order(), name, limit=end).where(F.col(name) > self.skip)
            return out.select(*self.fields, (F.col(name) - self.skip).alias(name))
        out = positioned(self.df, self.order(), name).where(F.col(name) > self.skip)
        return out.select(*self.fields, (F.col(name) - self.skip).alias(name))


def collection(df: DataFrame, key: Iterable[str], relation: str) -> View:
    """A keyed collection: identity and order are its key, ancestors' keys first."""
    key = list(key)
    hidden = {f"__id{i}": F.col(k) for i, k in enumerate(key)}
    return View(df.withColumns(hidden), len(key), relation=relation)


def singleton(df: DataFrame, relation: str = "/") -> View:
    """The root: one row without a key."""
    return View(df, 0, relation=relation)
