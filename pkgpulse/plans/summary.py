"""Monthly summary table, download lookups, JSON results and badges.

The reference answers one package per request. Here the primary form is one
job for all packages (``package_summary``); a lookup is a join of requested
names against it (``lookup_downloads``), so a batch of a million lookups is
one hash join, not a million queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgpulse.functions.client_types import DEFAULT_CLIENT_TYPES, client_type_predicate
from pkgpulse.functions.text import badge_markdown, with_thousands
from pkgpulse.functions.timeframes import parse_timeframe
from pkgpulse.operators.asof import asof_date, in_window
from pkgpulse.plans.reports import package_key

SUMMARY_WINDOW = "1 month"
SUMMARY_CLIENT_TYPE = 1


def last_month_summary(by_date: DataFrame, timeframe: str = SUMMARY_WINDOW) -> DataFrame:
    """Per (package_id, client_type_id): requests in the month before the
    table's latest date (open lower bound). Rebuilt in full after a load."""
    return (
        in_window(by_date, timeframe)
        .groupBy("package_id", "client_type_id")
        .agg(F.sum("request_count").cast("bigint").alias("total_requests"))
    )


def summary_state(rows: DataFrame) -> DataFrame:
    """Per (package_id, client_type_id) of the window's rows: total and number
    of rows. A key leaves the summary with its last row, not with a zero total."""
    return rows.groupBy("package_id", "client_type_id").agg(
        F.sum("request_count").cast("bigint").alias("total_requests"), F.count(F.lit(1)).alias("n_rows")
    )


def advance_summary(
    state: DataFrame,
    before: DataFrame,
    after: DataFrame,
    changed: Sequence[date],
    asof_before: date,
    asof_after: date,
    timeframe: str = SUMMARY_WINDOW,
) -> DataFrame:
    """The state of the window that ends at ``asof_after``, from that of the
    window that ended at ``asof_before``.

    ``before`` and ``after`` are the by-date table around a load, ``changed`` the
    dates that came or changed with it (a list, so that only those partitions are
    read). Taken off: unchanged dates that the window has left, and the old
    rows of changed dates; added: the new rows of changed dates in the window."""
    if asof_after < asof_before:
        raise ValueError("the as-of date never goes back")
    lower = parse_timeframe(timeframe).lower_bound
    low, new_low = lower(F.lit(asof_before)), lower(F.lit(asof_after))
    dated, is_changed = F.col("date"), F.col("date").isin(list(changed))
    left = before.where((dated > low) & (dated <= new_low) & ~is_changed)
    old = before.where((dated > low) & (dated <= F.lit(asof_before)) & is_changed)
    new = after.where((dated > new_low) & is_changed)
    counts = ("total_requests", "n_rows")
    off = summary_state(left.unionByName(old)).withColumns({c: -F.col(c) for c in counts})
    moved = state.unionByName(off).unionByName(summary_state(new))
    summed = moved.groupBy("package_id", "client_type_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])
    return summed.where("n_rows > 0")


def running_totals(by_date: DataFrame) -> DataFrame:
    """(package_id, client_type_id, date, running): cumulative requests on every
    date from a key's first one to the table's last one, missing days carried
    over. The total of any trailing window is the difference of two rows, so a
    report reads two dates a window, however long the window is."""
    keys = ["package_id", "client_type_id"]
    spans = by_date.groupBy(*keys).agg(F.min("date").alias("first"))
    days = spans.select(*keys, F.explode(F.sequence("first", asof_date(by_date))).alias("date"))
    # one key's rows are bounded by the calendar
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = days.join(by_date.select(*keys, "date", "request_count"), [*keys, "date"], "left")
    running = F.sum(F.coalesce("request_count", F.lit(0))).over(so_far).cast("bigint")
    return counted.select(*keys, "date", running.alias("running"))


def window_totals(
    running: DataFrame,
    packages: DataFrame,
    windows: Mapping[str, str],
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
) -> DataFrame:
    """Per package key: the total of each named trailing window, zero included,
    from the rows of ``running`` at the as-of date and at the lower bounds."""
    asof = asof_date(running)
    bounds = {name: parse_timeframe(t).lower_bound(asof) for name, t in windows.items()}
    rows = running.where(client_type_predicate(client_types)).where(F.col("date").isin(asof, *bounds.values()))
    at = lambda when: F.coalesce(F.sum(F.when(F.col("date") == when, F.col("running"))), F.lit(0))
    per_id = rows.groupBy("package_id").agg(*[(at(asof) - at(low)).alias(name) for name, low in bounds.items()])
    keyed = packages.select("package_id", package_key().alias("package_key"))
    return (
        keyed.join(per_id, "package_id", "left")
        .groupBy("package_key")
        .agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in windows])
    )


def package_summary(
    table: DataFrame,
    packages: DataFrame,
    count_col: str = "total_requests",
    client_type_id: int = SUMMARY_CLIENT_TYPE,
) -> DataFrame:
    """One row per lower-cased package name: the count of the package with
    the lowest id among those sharing the name (the lookup answers with one
    package's row, never a sum), raw and formatted, and both JSON bodies."""
    rows = table.where(F.col("client_type_id") == client_type_id).join(
        packages.select("package_id", "package_name"), "package_id"
    )
    per_key = rows.groupBy(package_key().alias("package_key")).agg(
        F.min_by(F.col(count_col).cast("bigint"), F.col("package_id")).alias("total_requests")
    )
    fmt = with_thousands("total_requests")
    return per_key.select(
        "package_key",
        "total_requests",
        fmt.alias("total_requests_fmt"),
        F.to_json(F.struct(fmt.alias("total_requests"))).alias("json_v1"),
        F.to_json(F.struct(F.col("total_requests"))).alias("json_v2"),
    )


def lookup_downloads(summary: DataFrame, names: DataFrame, name_col: str = "package_name") -> DataFrame:
    """Answer each requested name (matched ignoring case) from ``summary``.

    A name without a row answers ``{"package_name": <name>, "total_requests": 0}``
    in both API versions (a different shape from a hit)."""
    asked = names.select(F.col(name_col).alias("package_name")).distinct()
    joined = asked.join(summary, package_key("package_name") == F.col("package_key"), "left")
    missing = F.to_json(F.struct(F.col("package_name"), F.lit(0).alias("total_requests")))
    hit = F.col("package_key").isNotNull()
    return joined.select(
        "package_name",
        hit.alias("found"),
        F.coalesce(F.col("total_requests"), F.lit(0)).cast("bigint").alias("total_requests"),
        F.when(hit, F.col("json_v1")).otherwise(missing).alias("json_v1"),
        F.when(hit, F.col("json_v2")).otherwise(missing).alias("json_v2"),
    )


def monthly_downloads(summary_table: DataFrame, packages: DataFrame, names: DataFrame) -> DataFrame:
    """Lookups against the monthly summary (user downloads)."""
    return lookup_downloads(package_summary(summary_table, packages, "total_requests"), names)


def total_downloads(requests_total: DataFrame, packages: DataFrame, names: DataFrame) -> DataFrame:
    """Lookups against the all-time snapshot table (not a sum of by-date)."""
    return lookup_downloads(package_summary(requests_total, packages, "request_count"), names)


def badges(packages: DataFrame, **kwargs) -> DataFrame:
    """Badge markdown for every package name."""
    return packages.select("package_name", badge_markdown("package_name", **kwargs).alias("badge")).distinct()
