"""Page-level entry points: every report a page shows, as lazy DataFrames.

``Tables.load(spark, root)`` opens the curated tables; the page functions
return a dict of named DataFrames (nothing runs until an action). The
defaults are the pages' defaults: user downloads, 30 days, full system names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgpulse.functions.client_types import DEFAULT_CLIENT_TYPES
from pkgpulse.functions.text import cleanse_name
from pkgpulse.plans import reports, summary
from pkgpulse.sources.snapshots import read_table


@dataclass(frozen=True)
class Tables:
    packages: DataFrame
    requests_total: DataFrame
    requests_by_date: DataFrame
    requests_by_region_date: DataFrame
    systems_by_date: DataFrame
    versions_by_date: DataFrame
    requests_last_month: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "Tables":
        return cls(**{name: read_table(spark, name, root) for name in cls.__dataclass_fields__})


def all_packages_page(
    t: Tables,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    system_mode: str = "Full",
) -> dict[str, DataFrame]:
    ct = tuple(client_types)
    return {
        "kpis": reports.request_kpis(t.requests_by_date, timeframe, ct),
        "total_downloads": reports.requests_by(t.requests_by_date, ["date"], timeframe, ct),
        "version_downloads": reports.requests_by(t.versions_by_date, ["version", "date"], timeframe, ct),
        "version_share": reports.share_by(t.versions_by_date, "version", timeframe, ct),
        "region_downloads": reports.requests_by(t.requests_by_region_date, ["region", "date"], timeframe, ct),
        "region_share": reports.share_by(t.requests_by_region_date, "region", timeframe, ct),
        "system_downloads": reports.systems_by(t.systems_by_date, system_mode, timeframe, ct),
        "system_share": reports.system_share(t.systems_by_date, system_mode, timeframe, ct),
    }


def package_page(
    t: Tables,
    package_name: str,
    timeframe: str = "30d",
    client_types: Iterable[int] = DEFAULT_CLIENT_TYPES,
    cleanse: bool = True,
) -> dict[str, DataFrame]:
    """The package page; the requested name is cleansed first (trimmed,
    quotes / backslash / ``;`` / ``--`` / ``/`` / ``%`` removed). Its ids are
    looked up at once, so that the reports read those packages' row groups."""
    ct = tuple(client_types)
    if cleanse:
        package_name = cleanse_name(F.lit(package_name))
    ids = reports.ids_of(t.packages, package_name)
    region = reports.package_requests_by(
        t.requests_by_region_date, t.packages, ["region", "date"], package_name, timeframe, ct, package_ids=ids
    )
    return {
        "kpis": reports.request_kpis(
            t.requests_by_date,
            timeframe,
            ct,
            packages=t.packages,
            package_name=package_name,
            week="1 week",
            day="1 day",
            package_ids=ids,
        ),
        "total_downloads": reports.package_daily(t.requests_by_date, t.packages, package_name, timeframe, ct, ids),
        "region_downloads": region,
        "region_share": reports.package_share_by(
            t.requests_by_region_date, t.packages, "region", package_name, timeframe, ct, ids
        ),
    }


def top_page(t: Tables, client_types: Iterable[int] = DEFAULT_CLIENT_TYPES, display: bool = True) -> dict[str, DataFrame]:
    ct = tuple(client_types)
    out = {
        "month": reports.top_packages(t.requests_by_date, t.packages, "1 month", client_types=ct),
        "week": reports.top_packages(t.requests_by_date, t.packages, "7 day", client_types=ct),
        "day": reports.top_packages(t.requests_by_date, t.packages, "1 day", client_types=ct),
        "trending": reports.trending_packages(t.requests_by_date, t.packages, client_types=ct),
    }
    if display:
        out = {
            k: reports.display(v.drop("total_requests", "percent_change")) for k, v in out.items()
        }
    return out


def api_downloads(t: Tables, names: DataFrame) -> dict[str, DataFrame]:
    """Monthly and total download lookups for a frame of requested names."""
    return {
        "monthly_downloads": summary.monthly_downloads(t.requests_last_month, t.packages, names),
        "total_downloads": summary.total_downloads(t.requests_total, t.packages, names),
    }
