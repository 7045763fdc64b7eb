"""The update job: raw snapshot feeds -> curated tables -> monthly summary.

Order of work (each table all-or-nothing: stage, check, commit):

1. client types: insert the three constant rows if absent;
2. packages: union the registry extracts, first registry wins per uuid,
   new uuids get ids after the current maximum, existing rows are kept;
3. each fact feed: clean, aggregate, map keys, upsert into its table (only
   the dates the feed covers are rewritten);
4. rebuild the monthly summary from the updated by-date table;
5. create any table still missing (empty, with its schema).

Feeds are optional: a run with only some feeds updates only those tables.
Feed rows that cannot be loaded fail the job, or, with ``max_rejects``, go to
``<root>/_rejects/<feed>`` while their share stays within it.
The fact tables are independent of each other, so their loads are submitted
concurrently (one driver thread each; Spark runs the jobs side by side).
Each table is still all-or-nothing; a failed load is re-raised after the
others finish, as each table commits on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from pkgpulse.operators import ingest
from pkgpulse.operators.upsert import insert_absent
from pkgpulse.plans.dimensions import new_packages, refresh_packages
from pkgpulse.plans.summary import last_month_summary
from pkgpulse.plans.tables import merge_into_table, replace_table
from pkgpulse.schemas import (
    CLIENT_TYPES,
    PACKAGES,
    REQUESTS_BY_DATE,
    REQUESTS_BY_REGION_DATE,
    REQUESTS_LAST_MONTH,
    REQUESTS_TOTAL,
    SYSTEM_FEED_COLUMN,
    SYSTEMS_BY_DATE,
    TABLES,
    VERSION_FEED_COLUMN,
    VERSIONS_BY_DATE,
)
from pkgpulse.sources import versions
from pkgpulse.sources.registry import client_types_frame, read_registries, union_registries
from pkgpulse.sources.snapshots import (
    POSITION,
    create_if_missing,
    has_rows,
    read_feed,
    read_feed_checked,
    read_table,
    table_exists,
)

# feed name -> (target table, ingest function)
_PACKAGE_FEEDS = {
    "package_requests": (REQUESTS_TOTAL, ingest.ingest_requests_total),
    "package_requests_by_date": (REQUESTS_BY_DATE, ingest.ingest_requests_by_date),
    "package_requests_by_region_by_date": (REQUESTS_BY_REGION_DATE, ingest.ingest_requests_by_region_date),
}
_PLATFORM_FEEDS = {
    "systems_by_date": (SYSTEMS_BY_DATE, ingest.ingest_systems_by_date),
    "versions_by_date": (VERSIONS_BY_DATE, ingest.ingest_versions_by_date),
}


def _require_dimensions(spark: SparkSession, root: str) -> None:
    """Stop before any numbering when facts are stored but a dimension that
    they refer to is gone or empty: new ids would name other packages."""
    lost = [
        d.name
        for d in (CLIENT_TYPES, PACKAGES)
        if not table_exists(spark, d, root) or not has_rows(read_table(spark, d, root))
    ]
    for spec, _ in (*_PACKAGE_FEEDS.values(), *_PLATFORM_FEEDS.values()) if lost else ():
        if table_exists(spark, spec, root) and has_rows(read_table(spark, spec, root)):
            needs = [d for d in lost if d == CLIENT_TYPES.name or "package_id" in spec.columns]
            if needs:
                raise RuntimeError(f"{spec.name} has rows but {needs} cannot be found under {root}; restore it first")


class RejectedError(RuntimeError):
    """More rows of a feed than allowed cannot be loaded."""


def quarantine(rejects: DataFrame, good: DataFrame, feed: str, root: str, most: float) -> str | None:
    """Write the rejected rows of one load of a feed under ``root`` and return
    the folder (None if there are none); raise if they are more than the share
    ``most`` of the feed. They are written first, so that a refused load can be
    looked into."""
    path = f"{root.rstrip('/')}/_rejects/{feed}/{uuid.uuid4().hex}"
    rejects.write.parquet(path)
    spark = rejects.sparkSession
    n_bad = spark.read.schema(rejects.schema).parquet(path).count()
    if not n_bad:
        versions.delete(spark, path)
        return None
    n = n_bad + good.count()
    if n_bad > most * n:
        raise RejectedError(f"{feed}: {n_bad} of {n} rows cannot be loaded; they are in {path}")
    return path


def run_update(
    spark: SparkSession,
    root: str,
    feeds: Mapping[str, str | DataFrame],
    registries: Sequence[str | DataFrame] = (),
    partitions: int | None = None,
    combine: str = "sum",
    refresh_names: bool = False,
    parallel: bool = True,
    max_lengths: Mapping[str, int] | None = None,
    max_rejects: float | None = None,
) -> dict[str, DataFrame]:
    """Run one update. ``feeds`` maps feed name -> CSV path (or a frame with
    the feed's columns); ``registries`` are extract paths (CSV) or frames.

    ``combine='last'`` lets, of the feed rows that share a truncated platform
    or version, the last one in the feed's row order win (a feed given as a
    frame is ordered by its full string instead, as it has no row order).
    ``max_lengths`` replaces length limits of columns. ``max_rejects`` is the
    largest share of a feed's rows that may be rejected (feeds given as paths)."""
    written: dict[str, DataFrame] = {}

    # Dimensions are rewritten only when something changed (bounded checks).
    _require_dimensions(spark, root)
    client_types = read_table(spark, CLIENT_TYPES, root, absent_ok=True)
    constants = client_types_frame(spark)
    if has_rows(constants.join(client_types.select("client_type"), "client_type", "left_anti")):
        ct = insert_absent(client_types, constants, ["client_type"])
        client_types = replace_table(spark, ct, CLIENT_TYPES, root)
        written[CLIENT_TYPES.name] = client_types

    packages = read_table(spark, PACKAGES, root, absent_ok=True)
    if registries:
        frames = [r for r in registries if isinstance(r, DataFrame)]
        paths = [r for r in registries if isinstance(r, str)]
        if frames and paths:
            raise ValueError("pass registries either all as paths or all as frames")
        extract = union_registries(frames) if frames else read_registries(spark, paths)
        if refresh_names or has_rows(new_packages(packages, extract)):
            refreshed = refresh_packages(packages, extract, refresh_names)
            packages = replace_table(spark, refreshed, PACKAGES, root)
            written[PACKAGES.name] = packages
    dims = {PACKAGES.name: packages, CLIENT_TYPES.name: client_types}

    in_order = combine == "last"

    def load(feed: str) -> DataFrame:
        src = feeds[feed]
        if isinstance(src, DataFrame):
            return src
        if max_rejects is None:
            return read_feed(spark, feed, src, partitions, position=in_order and feed in _PLATFORM_FEEDS)
        required = ("status", "request_count") if feed in _PACKAGE_FEEDS else ()
        good, rejects = read_feed_checked(spark, feed, src, required, position=in_order and feed in _PLATFORM_FEEDS)
        quarantine(rejects, good, feed, root, max_rejects)
        return good.repartition(partitions) if partitions else good

    loads = []
    for feed, (spec, fn) in _PACKAGE_FEEDS.items():
        if feed in feeds:
            loads.append((spec, fn(load(feed), packages, client_types)))
    for feed, (spec, fn) in _PLATFORM_FEEDS.items():
        if feed in feeds:
            order = SYSTEM_FEED_COLUMN if feed == "systems_by_date" else VERSION_FEED_COLUMN
            rows = load(feed)
            order = POSITION if POSITION in rows.columns else order
            loads.append((spec, fn(rows, client_types, combine=combine, order_col=order)))

    def merge(item):
        spec, rows = item
        return spec.name, merge_into_table(spark, rows, spec.limited(max_lengths or {}), root, dims)

    errors = []
    if parallel and len(loads) > 1:
        with ThreadPoolExecutor(max_workers=len(loads), thread_name_prefix="pkgpulse-load") as pool:
            futures = [pool.submit(merge, item) for item in loads]
        errors = [f.exception() for f in futures if f.exception() is not None]
        written.update(f.result() for f in futures if f.exception() is None)
    else:
        written.update(merge(item) for item in loads)

    # the summary follows its table, also when the load of another table failed
    if REQUESTS_BY_DATE.name in written:
        by_date = read_table(spark, REQUESTS_BY_DATE, root)
        written[REQUESTS_LAST_MONTH.name] = replace_table(
            spark, last_month_summary(by_date), REQUESTS_LAST_MONTH, root, dims
        )
    if errors:
        raise errors[0]
    # every table exists after a run, even those no feed has filled yet
    for spec in TABLES.values():
        if spec.name not in written:
            create_if_missing(spark, spec, root)
    return written
