"""Trailing-window reports over the curated fact tables.

Every builder takes DataFrames and returns a lazy DataFrame. Shared shape:

    fact --(date > asof - timeframe, client type in selection)--> rows
         --(optional: join package names)--> groupBy(keys).sum(request_count)

The as-of date is a scalar subquery over the whole fact table, so on a
date-partitioned table only the window's partitions are scanned. Package
names come from the package dimension by a broadcast hash join when the
planner's size estimate allows (the dimension grows with the registry, not
with the log). Sums are partial-aggregated map-side before the one shuffle.

Defaults follow the reference pages: user downloads only, 30 days for the
pages, ``1 month`` / ``7 day`` / ``1 day`` for the top lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.functions.client_types import DEFAULT_CLIENT_TYPES, client_type_predicate
from pkgpulse.functions.systems import system_label
from pkgpulse.functions.text import percent_text, with_thousands
from pkgpulse.functions.timeframes import days_between, parse_timeframe
from pkgpulse.operators.asof import asof_date, in_window, ledger_of
from pkgpulse.operators.shares import with_daily_share

# List sizes and trending thresholds of the reference pages.
TOP_N = 100
TRENDING_N = 10
TRENDING_DAILY_MINIMUM = 5
TRENDING_MIN_ROWS = 12  # a period must have more than this many rows
# Last period: asof-14 .. asof (15 dates); previous: asof-27 .. asof-14 (14
# dates). Both closed, so the day asof-14 belongs to both.
LAST_PERIOD = (14, 0)
PREVIOUS_PERIOD = (27, 14)
EXCLUDED_NAME_PATTERN = "%_jll"  # SQL LIKE: '_' matches any one character

DISPLAY_NAMES = {
    "package_name": "Package Name",
    "total_requests_fmt": "Total Requests",
    "percent_change_fmt": "Percent Change",
}


def sort_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``ORDER BY a, b, c DESC``: only the last column descends."""
    cols = list(cols)
    return df.orderBy(*[F.col(c).asc() for c in cols[:-1]], F.col(cols[-1]).desc())


def _order(df: DataFrame, cols: Sequence[str], order: str | None) -> DataFrame:
    """Display order. ``None`` leaves the rows unsorted (no global sort:
    the right choice for batch outputs that feed other jobs)."""
    if order is None:
        return df
    if order == "report":
        return sort_report(df, cols)
    if order == "asc":
        return df.orderBy(*cols)
    raise ValueError("order must be 'report', 'asc' or None")


def _window_rows(fact: DataFrame, timeframe, client_types) -> DataFrame:
    return in_window(fact, timeframe).where(client_type_predicate(client_types))


def package_key(name: Column | str = "package_name") -> Column:
    """Per-package lookups match names ignoring case."""
    return F.lower(F.col(name) if isinstance(name, str) else name)


def name_match(package_name: str | Column) -> Column:
    """Predicate on ``package_key`` for a requested name (text or a Column,
    e.g. a cleansed input), compared ignoring case."""
    asked = F.lit(package_name) if isinstance(package_name, str) else package_name
    return F.col("package_key") == F.lower(asked)


def _named(rows: DataFrame, packages: DataFrame) -> DataFrame:
    names = packages.select("package_id", "package_name", package_key().alias("package_key"))
    return rows.join(names, "package_id")


def ids_of(packages: DataFrame, package_name: str | Column, most: int = 1000) -> list[int] | None:
    """The ids of the packages of a name (an action: the ids reach the driver),
    or None if there are more than ``most``; given to a report, they become a
    filter that the scan of the fact table applies to row groups."""
    found = packages.select("package_id", package_key().alias("package_key")).where(name_match(package_name))
    ids = [r[0] for r in found.select("package_id").distinct().limit(most + 1).collect()]
    return sorted(ids) if len(ids) <= most else None


def _of_ids(rows: DataFrame, package_ids: Sequence[int] | None) -> DataFrame:
    return rows if package_ids is None else rows.where(F.col("package_id").isin(list(package_ids)))


def _per_id(rows: DataFrame, cols: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates per package id, so that the name join sees one row per id
    (and ``cols``) and not every row of the window. Sums and counts per id add
    up to those of a name that several ids share."""
    return rows.groupBy("package_id", *cols).agg(*aggregates)


# ---------------------------------------------------------------- totals


def requests_by(
    fact: DataFrame,
    group_cols: Sequence[str],
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    order: str | None = "report",
) -> DataFrame:
    """``SUM(request_count) AS total_requests`` per ``group_cols`` over the
    trailing window (all packages). ``group_cols`` e.g. ``['date']``,
    ``['version', 'date']``, ``['region', 'date']``."""
    rows = _window_rows(fact, timeframe, client_types)
    out = rows.groupBy(*group_cols).agg(F.sum("request_count").alias("total_requests"))
    return _order(out, group_cols, order)


def package_requests_by(
    fact: DataFrame,
    packages: DataFrame,
    group_cols: Sequence[str],
    package_name: str | Column | None = None,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    order: str | None = "auto",
    package_ids: Sequence[int] | None = None,
) -> DataFrame:
    """``requests_by`` for one package (name matched ignoring case; packages
    sharing it are summed), or for every package at once when
    ``package_name`` is None (``package_key`` then leads the keys).

    ``order='auto'`` sorts a single package's rows for display and leaves
    the all-package batch unsorted (it feeds other jobs; a global sort of
    every package's rows would be a needless range shuffle). ``package_ids``
    (``ids_of`` the name) limits the scan to those packages."""
    rows = _of_ids(_window_rows(fact, timeframe, client_types), package_ids)
    keys = list(group_cols)
    if package_name is not None:
        # the name join is a filter here: it goes before the aggregation
        rows = _named(rows, packages).where(name_match(package_name))
    else:
        rows = _named(_per_id(rows, keys, F.sum("request_count").alias("request_count")), packages)
        keys = ["package_key", *keys]
    out = rows.groupBy(*keys).agg(F.sum("request_count").alias("total_requests"))
    if order == "auto":
        order = "report" if package_name is not None else None
    return _order(out, keys, order)


def package_daily(
    fact: DataFrame,
    packages: DataFrame,
    package_name: str | Column | None = None,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    package_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Daily totals of a package, date ascending (for every package at once
    when ``package_name`` is None: unsorted batch)."""
    order = "asc" if package_name is not None else None
    return package_requests_by(fact, packages, ["date"], package_name, timeframe, client_types, order, package_ids)


# ------------------------------------------------------------- shares


def share_by(
    fact: DataFrame,
    series_col: str,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
) -> DataFrame:
    """Per (date, series): total, day total and proportion of the day."""
    totals = requests_by(fact, [series_col, "date"], timeframe, client_types, order=None)
    return with_daily_share(totals, series_col)


def package_share_by(
    fact: DataFrame,
    packages: DataFrame,
    series_col: str,
    package_name: str | Column | None = None,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    package_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Share of a package's day per series (or of every package's day)."""
    totals = package_requests_by(
        fact, packages, [series_col, "date"], package_name, timeframe, client_types, None, package_ids
    )
    parts = ["date"] if package_name is not None else ["package_key", "date"]
    return with_daily_share(totals, series_col, partition_cols=parts)


def systems_by(
    systems: DataFrame,
    mode: str = "Full",
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
) -> DataFrame:
    """Requests per (display system, date). The label (``arch-os``, arch or
    OS) is computed per row before the one aggregation, which equals summing
    per stored system first and re-summing per label."""
    rows = _window_rows(systems, timeframe, client_types)
    labelled = rows.select(system_label("system", mode).alias("selected_system"), "date", "request_count")
    return labelled.groupBy("selected_system", "date").agg(F.sum("request_count").alias("total_requests"))


def system_share(
    systems: DataFrame,
    mode: str = "Full",
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
) -> DataFrame:
    return with_daily_share(systems_by(systems, mode, timeframe, client_types), "selected_system")


# --------------------------------------------------------------- KPIs


def request_kpis(
    fact: DataFrame,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    packages: DataFrame | None = None,
    package_name: str | Column | None = None,
    by_package: bool = False,
    week: str = "7d",
    day: str = "1d",
    package_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Past day, past week and selected-timeframe totals in one scan.

    One conditional sum per window over the rows of the widest window;
    empty windows give 0. All packages (one row), one package (one row,
    name matched ignoring case) or every package (``by_package``; packages
    without requests get zeros)."""
    asof = asof_date(fact)
    bounds = {
        "past_day_requests": parse_timeframe(day).lower_bound(asof),
        "past_week_requests": parse_timeframe(week).lower_bound(asof),
        "selected_timeframe_requests": parse_timeframe(timeframe).lower_bound(asof),
    }
    widest = F.least(*bounds.values())
    # no date is beyond the as-of date, but for one whose commit the ledger does not know yet
    inside = F.col("date") > widest if ledger_of(fact) is None else (F.col("date") > widest) & (F.col("date") <= asof)
    rows = _of_ids(fact.where(inside & client_type_predicate(client_types)), package_ids)
    sums = [
        F.coalesce(F.sum(F.when(F.col("date") > low, F.col("request_count"))), F.lit(0)).cast("bigint").alias(name)
        for name, low in bounds.items()
    ]
    if packages is None:
        out = rows.agg(*sums)
    else:
        if package_name is not None:
            out = _named(rows, packages).where(name_match(package_name)).agg(*sums)
        elif by_package:
            named = _named(_per_id(rows, [], *sums), packages)
            per = named.groupBy("package_key").agg(*[F.sum(n).alias(n) for n in bounds])
            keys = packages.select(package_key().alias("package_key")).distinct()
            out = keys.join(per, "package_key", "left").select(
                "package_key", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in bounds]
            )
        else:
            out = _named(rows, packages).agg(*sums)
    return out.select("*", *[with_thousands(n).alias(f"{n}_fmt") for n in bounds])


# ---------------------------------------------------------- top lists


def top_packages(
    fact: DataFrame,
    packages: DataFrame,
    timeframe: str = "1 month",
    n: int = TOP_N,
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
) -> DataFrame:
    """The ``n`` packages (by exact name) with most requests in the window.

    Ties are broken by name, so the list is deterministic. ``orderBy +
    limit`` plans as a per-partition top-n and a final merge
    (``TakeOrderedAndProject``), never a global sort."""
    rows = _window_rows(fact, timeframe, client_types)
    named = _named(_per_id(rows, [], F.sum("request_count").alias("request_count")), packages)
    totals = named.groupBy("package_name").agg(F.sum("request_count").alias("total_requests"))
    top = totals.orderBy(F.desc("total_requests"), F.asc("package_name")).limit(n)
    return top.select("package_name", "total_requests", with_thousands("total_requests").alias("total_requests_fmt"))


def trending_packages(
    fact: DataFrame,
    packages: DataFrame,
    n: int = TRENDING_N,
    daily_minimum: int = TRENDING_DAILY_MINIMUM,
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    min_rows: int = TRENDING_MIN_ROWS,
    last_period: tuple[int, int] = LAST_PERIOD,
    previous_period: tuple[int, int] = PREVIOUS_PERIOD,
) -> DataFrame:
    """Packages growing most from the previous two weeks to the last two.

    Periods are ``(first, last)`` days before the as-of date, both ends
    included; the defaults share the day asof-14.

    Rows count only when ``request_count > daily_minimum``; names matching
    ``%_jll`` are left out; each period needs more than ``min_rows`` rows
    (rows, not distinct dates); only growth is listed. Both periods come
    from one scan with conditional aggregates (no self-join).

    ``percent_change = round(100 * (last - prev) / prev, 2)`` is computed in
    exact integer arithmetic (half-up on basis points; last > prev > 0)."""
    asof = asof_date(fact)
    in_last = days_between("date", asof, *last_period)
    in_prev = days_between("date", asof, *previous_period)
    rows = fact.where(
        (in_last | in_prev)
        & client_type_predicate(client_types)
        & (F.col("request_count") > daily_minimum)
    )
    ids = _per_id(
        rows,
        [],
        F.sum(F.when(in_last, F.col("request_count"))).alias("last_total"),
        F.count(F.when(in_last, F.col("date"))).alias("last_rows"),
        F.sum(F.when(in_prev, F.col("request_count"))).alias("prev_total"),
        F.count(F.when(in_prev, F.col("date"))).alias("prev_rows"),
    )
    named = _named(ids, packages).where(~F.col("package_name").like(EXCLUDED_NAME_PATTERN))
    totals = ("last_total", "last_rows", "prev_total", "prev_rows")
    per = named.groupBy("package_name").agg(*[F.sum(c).alias(c) for c in totals])
    growing = per.where(
        (F.col("last_rows") > min_rows)
        & (F.col("prev_rows") > min_rows)
        & (F.col("last_total") > F.col("prev_total"))
        & (F.col("prev_total") > 0)  # growth from nothing has no percentage
    )
    bp = F.expr("(20000 * (last_total - prev_total) + prev_total) div (2 * prev_total)")
    scored = growing.select("package_name", (bp / F.lit(100.0)).alias("percent_change"))
    top = scored.orderBy(F.desc("percent_change"), F.asc("package_name")).limit(n)
    return top.select("package_name", "percent_change", percent_text("percent_change").alias("percent_change_fmt"))


def display(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename to the page's column titles (only the columns present)."""
    mapping = {k: v for k, v in (names or DISPLAY_NAMES).items() if k in df.columns}
    return df.withColumnsRenamed(mapping)
