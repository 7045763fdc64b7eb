"""Timeframes and trailing-window predicates.

A report window is anchored at the as-of date (the table's latest date) and
is open at the lower bound: ``date > asof - interval``. So ``1 day`` keeps one
date, ``7d`` seven, ``30d`` thirty. Month and year steps clamp month ends
(``2024-03-31 - 1 month = 2024-02-29``), as SQL interval arithmetic does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report timeframe options and what "all" stands for.
TIMEFRAME_OPTIONS = ("30d", "60d", "120d", "all")
ALL_TIME = "100 years"

_DAY_UNITS = {"d": 1, "day": 1, "days": 1, "w": 7, "week": 7, "weeks": 7}
_MONTH_UNITS = {"mon": 1, "month": 1, "months": 1, "y": 12, "year": 12, "years": 12}
_PATTERN = re.compile(r"^\s*(\d+)\s*([a-z]+)\s*$")


@dataclass(frozen=True)
class Timeframe:
    """A whole-day interval: ``months`` calendar months plus ``days`` days."""

    days: int = 0
    months: int = 0

    def lower_bound(self, asof: Column) -> Column:
        bound = asof
        if self.months:
            bound = F.add_months(bound, -self.months)
        if self.days:
            bound = F.date_sub(bound, self.days)
        return bound

    def sql(self) -> str:
        """The same interval as an ANSI literal (for SQL text / oracles)."""
        parts = []
        if self.months:
            parts.append(f"INTERVAL '{self.months}' MONTH")
        if self.days or not parts:
            parts.append(f"INTERVAL '{self.days}' DAY")
        return " + ".join(parts)


def parse_timeframe(value: str | Timeframe) -> Timeframe:
    """``'30d'``, ``'1 month'``, ``'7 day'``, ``'1 week'``, ``'all'`` -> Timeframe."""
    if isinstance(value, Timeframe):
        return value
    text = value.strip().lower()
    if text == "all":
        text = ALL_TIME
    match = _PATTERN.match(text)
    if not match:
        raise ValueError(f"unsupported timeframe: {value!r}")
    n, unit = int(match.group(1)), match.group(2)
    if unit in _DAY_UNITS:
        return Timeframe(days=n * _DAY_UNITS[unit])
    if unit in _MONTH_UNITS:
        return Timeframe(months=n * _MONTH_UNITS[unit])
    raise ValueError(f"unsupported timeframe unit: {value!r}")


def trailing(date_col: Column | str, asof: Column, timeframe: str | Timeframe) -> Column:
    """``date > asof - timeframe`` (open lower bound, as-of date included)."""
    col = F.col(date_col) if isinstance(date_col, str) else date_col
    return col > parse_timeframe(timeframe).lower_bound(asof)


def days_between(date_col: Column | str, asof: Column, first: int, last: int) -> Column:
    """``date BETWEEN asof - first days AND asof - last days`` (both ends closed)."""
    col = F.col(date_col) if isinstance(date_col, str) else date_col
    return col.between(F.date_sub(asof, first), F.date_sub(asof, last))
