"""The as-of date of a fact table and trailing-window restriction.

The as-of date is ``MAX(date)`` over the whole (unfiltered) table, not today.
It is expressed as a scalar subquery, so on a date-partitioned Parquet table
the window predicate becomes a partition filter (only the window's date
folders are read).

On its own the subquery reads no column, but opens every file of the table for
its row count. A stored table therefore comes with the ledger that its commits
keep, one row per date (``with_ledger``): the subquery then reads that, and no
file of the table. The window ends at the as-of date as well, so that dates
whose commit has not reached the ledger yet do not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.functions.timeframes import Timeframe, trailing

_LEDGER = "_pkgpulse_ledger"


def with_ledger(fact: DataFrame, ledger: DataFrame) -> DataFrame:
    """``fact`` with the ledger of its dates. Frames derived from it do not
    inherit the ledger: their as-of date is their own ``MAX(date)``."""
    fact.__dict__[_LEDGER] = ledger
    return fact


def ledger_of(fact: DataFrame) -> DataFrame | None:
    return fact.__dict__.get(_LEDGER)


def asof_date(fact: DataFrame, date_col: str = "date") -> Column:
    ledger = ledger_of(fact)
    if ledger is None:
        return fact.select(F.max(date_col)).scalar()
    return ledger.where("table_rows > 0").select(F.max("date")).scalar()


def in_window(fact: DataFrame, timeframe: str | Timeframe, date_col: str = "date") -> DataFrame:
    asof = asof_date(fact, date_col)
    rows = fact.where(trailing(date_col, asof, timeframe))
    return rows if ledger_of(fact) is None else rows.where(F.col(date_col) <= asof)
