"""Named day ranges, and the columns that map a day onto them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """A named range of days, both ends included."""

    name: str
    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"period {self.name!r} ends before it starts")

    @property
    def n_days(self) -> int:
        return (self.end - self.start).days + 1

    def holds(self, day: str) -> str:
        """SQL condition that a date column lies in the period."""
        return f"{day} BETWEEN DATE'{self.start}' AND DATE'{self.end}'"

    @classmethod
    def year(cls, year: int, name: str | None = None) -> Period:
        return cls(name or str(year), date(year, 1, 1), date(year, 12, 31))


def check_disjoint(periods: Sequence[Period]) -> Sequence[Period]:
    """One log row may count towards one period only, so overlaps are refused."""
    if not periods:
        raise ValueError("at least one period is needed")
    if len({p.name for p in periods}) != len(periods):
        raise ValueError("period names must differ")
    ordered = sorted(periods, key=lambda p: p.start)
    for before, after in zip(ordered, ordered[1:]):
        if after.start <= before.end:
            raise ValueError(f"periods {before.name!r} and {after.name!r} overlap")
    return periods


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_any(day: str, periods: Sequence[Period]) -> Column:
    """Filter for the days of any of the periods; it reaches the file scan."""
    return F.expr(" OR ".join(f"({p.holds(day)})" for p in periods))


def period_index(day: str, periods: Sequence[Period]) -> Column:
    """Position of the period a day lies in, -1 outside all of them.

    Never NULL: joins on a nullable key would add their own filter below it and
    so keep Spark from sharing the work between branches.
    """
    arms = " ".join(f"WHEN {p.holds(day)} THEN {i}" for i, p in enumerate(periods))
    return F.expr(f"CASE {arms} ELSE -1 END")


def period_start(day: str, periods: Sequence[Period]) -> Column:
    """First day of the period a day lies in; NULL outside all of them."""
    arms = " ".join(f"WHEN {p.holds(day)} THEN DATE'{p.start}'" for p in periods)
    return F.expr(f"CASE {arms} END")


def period_name(index: str, periods: Sequence[Period]) -> Column:
    """Name of the period at a position, the inverse of ``period_index``; empty for -1."""
    return F.expr(f"coalesce(get(array({', '.join(quoted(p.name) for p in periods)}), {index}), '')")
