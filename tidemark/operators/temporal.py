"""Validity in time: buckets, recurring series, selection by instant and range.

Intervals are half-open, [from, until); none as an end means for ever.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.view import StaticError, View

FROM, UNTIL, INDEX = "__from", "__until", "__index"
#: Intervals that one series may have within a horizon.
SERIES_CAP = 200_000


def bucket(view: View, start: Column, until: Column | None = None) -> View:
    """Gives rows their interval."""
    end = F.lit(None).cast("timestamp") if until is None else until.cast("timestamp")
    return view.on(view.df.withColumns({FROM: start.cast("timestamp"), UNTIL: end}))


def at(view: View, instant: Column) -> View:
    """Rows whose interval holds the instant."""
    df = view.df.where((F.col(FROM) <= instant) & (F.col(UNTIL).isNull() | (instant < F.col(UNTIL))))
    return view.on(df, unbounded=False)


def between(view: View, start: datetime | Column, end: datetime | Column) -> View:
    """Rows whose interval meets [start, end); an empty range is an error."""
    if isinstance(start, datetime) and isinstance(end, datetime) and end <= start:
        raise ValueError("an empty or reversed range")
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return view.on(view.df.where((F.col(FROM) < b) & (F.col(UNTIL).isNull() | (F.col(UNTIL) > a))), unbounded=False)


def always(view: View) -> View:
    """All rows, whatever their interval."""
    if view.unbounded:
        raise StaticError("an endless series is read only at an instant or between two")
    return view


def reversed_intervals(view: View) -> View:
    """Rows whose interval does not run forward; must be empty before a transition is admitted."""
    return view.on(view.df.where(F.col(UNTIL).isNotNull() & (F.col(UNTIL) <= F.col(FROM))))


def recurring(view: View, anchor: Column, step_micros: Column, until: Column | None, horizon: Column) -> View:
    """One row for each interval of a fixed length from the anchor on, up to its end or the horizon.

    Boundary i is the anchor plus i steps.  The last interval is clipped to the
    series' end, not to the horizon.  The number of intervals is worked out per
    row, so a series is generated where its source row is.
    """
    anchor = F.unix_micros(anchor.cast("timestamp"))
    end = F.lit(None).cast("long") if until is None else F.unix_micros(until.cast("timestamp"))
    stop = F.least(F.coalesce(end, F.unix_micros(horizon)), F.unix_micros(horizon))
    n = F.when(stop > anchor, F.call_function("div", stop - anchor + step_micros - 1, step_micros)).otherwise(F.lit(0))
    n = F.when(step_micros <= 0, F.raise_error(F.lit("a period that does not advance")).cast("long")).when(n > SERIES_CAP, F.raise_error(F.lit("too many intervals")).cast("long")).otherwise(n)
    start = anchor + F.col(INDEX) * step_micros
    df = view.df.withColumns({"__anchor": anchor, "__n": n}).where("__n > 0")
    df = df.withColumn(INDEX, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    df = df.withColumns({FROM: F.timestamp_micros(start), UNTIL: F.timestamp_micros(F.least(start + step_micros, end))})
    return _series(view, df.drop("__anchor", "__n"))


def recurring_calendar(view: View, anchor: Column, months: int, until: Column | None, horizon: Column, overflow: str = "clamp") -> View:
    """Like ``recurring`` with steps of months: boundary i is the anchor plus i times the months, so the day of the month is kept.

    A day that a month lacks becomes its last (``clamp``) or is an error (``reject``).
    """
    if months <= 0:
        raise StaticError("a period that does not advance")
    anchor = anchor.cast("timestamp")
    end = F.lit(None).cast("timestamp") if until is None else until.cast("timestamp")
    stop = F.least(F.coalesce(end, horizon), horizon)
    n = F.greatest(F.lit(0), (F.ceil(F.months_between(stop, anchor) / months) + 1).cast("long"))
    boundary = lambda i: anchor + F.make_ym_interval(F.lit(0), (i * months).cast("int"))
    df = view.df.withColumn("__n", n).where("__n > 0")
    df = df.withColumn(INDEX, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = boundary(F.col(INDEX))
    if overflow == "reject":
        start = F.when(F.dayofmonth(start) == F.dayofmonth(anchor), start).otherwise(F.raise_error(F.lit("a month without this day")).cast("timestamp"))
    elif overflow != "clamp":
        raise StaticError(f"no overflow policy {overflow}")
    df = df.withColumns({FROM: start, UNTIL: F.least(boundary(F.col(INDEX) + 1), end)}).where(F.col(FROM) < stop)
    return _series(view, df.drop("__n"))


def _series(view: View, df) -> View:
    df = df.withColumn(f"__id{view.ids}", F.col(FROM))
    return View(df, view.ids + 1, (), f"{view.relation}@series")


def zoned_boundary(local: datetime, zone: str, ambiguous: str = "earlier", missing: str = "later") -> datetime:
    """The instant of a wall-clock time; clocks that go back make it ambiguous, clocks that go forward leave it out."""
    z = ZoneInfo(zone)
    early, late = (local.replace(tzinfo=z, fold=f) for f in (0, 1))
    if early.utcoffset() == late.utcoffset():
        return early.astimezone(ZoneInfo("UTC"))
    gap = early.utcoffset() < late.utcoffset()
    policy = missing if gap else ambiguous
    if policy == "reject":
        raise ValueError("a wall-clock time that does not exist" if gap else "a wall-clock time that comes twice")
    first, second = sorted((early, late), key=lambda t: t.astimezone(ZoneInfo("UTC")))
    return (first if policy == "earlier" else second).astimezone(ZoneInfo("UTC"))


def series_key_conflicts(view: View, key: list[str]) -> View:
    """Keys that several rows of a generated series share; must be empty within the horizon."""
    from pyspark.sql import Window

    df = view.df.withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return view.on(df.where("__same > 1").drop("__same"))
