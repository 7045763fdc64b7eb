"""

Every registered query reads the provided test tables (through the request
log fixtures of ``pkgpulse.sources.testdata``, which Spark derives from
``events`` and ``region``) and runs a library builder over the whole data.
``oracle_sql`` states the same result in DuckDB SQL (``oracle_queries``).
"""

from __future__ import annotations

import datetime
import os
import sys
import uuid
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from pkgpulse.functions.systems import system_label  # noqa: E402
from pkgpulse.functions.text import cleanse_name, url_contains  # noqa: E402
from pkgpulse.functions.timeframes import parse_timeframe  # noqa: E402
from pkgpulse.operators import ingest, quality, upsert  # noqa: E402
from pkgpulse.operators.shares import as_series  # noqa: E402
from pkgpulse.plans import dimensions, reports, summary  # noqa: E402
from pkgpulse.plans.tables import digests, merge_into_table  # noqa: E402
from pkgpulse.plans.update import run_update  # noqa: E402
from pkgpulse.schemas import SYSTEM_FEED_COLUMN, TABLES  # noqa: E402
from pkgpulse.session import shared_dir  # noqa: E402
from pkgpulse.sources import testdata as T  # noqa: E402
from pkgpulse.sources import versions  # noqa: E402
from pkgpulse.sources.snapshots import POSITION, read_feed, read_feed_checked, read_ledger, read_table  # noqa: E402
from pkgpulse.streaming.snapshots import SNAPSHOT_COLS, run_snapshot_ingest  # noqa: E402

# the training-data operators are optional: without their subpackage (or what it imports) the rest works
try:
    from pkgpulse.llm import queries as llm  # noqa: E402
except ImportError:
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
#: the region names of the test tables are longer than the feeds' region codes
LONGEST_REGION = 11


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top packages of the last month (user downloads)."""
    return _top("1 month")(spark, SMOKE_DIR)


# ----------------------------------------------------------------- helpers


def _by_date(spark, d):
    return T.requests_by_date(spark, d)


def _by_region(spark, d):
    return T.requests_by_region_date(spark, d)


def _top(window: str):
    def run(spark, d):
        return reports.top_packages(_by_date(spark, d), T.packages(spark, d), window)

    return run


def _totals_by_toggles(spark, d) -> DataFrame:
    """The month's total for every choice of client types; none chosen is 0."""
    out = None
    for chosen in ((), (1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3)):
        daily = reports.requests_by(_by_date(spark, d), ["date"], client_types=chosen, order=None)
        total = daily.agg(F.coalesce(F.sum("total_requests"), F.lit(0)).alias("total_requests"))
        part = total.select(F.lit(",".join(map(str, chosen))).alias("chosen"), "total_requests")
        out = part if out is None else out.unionByName(part)
    return out


def _lookup_names(spark, d) -> DataFrame:
    """Requested names: each registered name upper-cased, plus Pkg0..Pkg13."""
    ev = T.table(spark, d, "events")
    asked_events = ev.select(F.concat(F.lit("Pkg"), (F.col("user_id") % 14).cast("string")).alias("package_name"))
    asked_names = T.packages(spark, d).select(F.upper("package_name").alias("package_name"))
    return asked_names.unionByName(asked_events).distinct()


def _registry_extracts(spark, d) -> list[DataFrame]:
    """Two registries: the registered packages (names upper-cased, so that
    keeping existing names is visible) and every uuid seen in the log."""
    pk = T.packages(spark, d)
    first = pk.select("package_uuid", F.upper("package_name").alias("package_name"))
    seen = (
        T.raw_requests(spark, d)
        .select("package_uuid")
        .distinct()
        .select("package_uuid", F.concat(F.lit("Reg"), F.substring("package_uuid", 6, 10)).alias("package_name"))
    )
    return [first, seen]


def _insert_absent(spark, d):
    return dimensions.refresh_packages(T.packages(spark, d), _registry_extracts(spark, d))


def _snapshots(spark, d):
    """An earlier load counted failed requests as well (old table); the new
    snapshot is the correct trailing two weeks."""
    feed = T.package_feed(spark, d)
    pk, ct = T.packages(spark, d), T.client_types(spark)
    old = ingest.ingest_requests_by_date(feed.withColumn("status", F.lit(200)), pk, ct)
    asof = feed.select(F.max("date")).scalar()
    recent = feed.where(F.col("date") > F.date_sub(asof, 14))
    return old, ingest.ingest_requests_by_date(recent, pk, ct)


def _upsert_replace(spark, d):
    """Replaced keys take the new counts, older keys stay as loaded."""
    old, new = _snapshots(spark, d)
    return upsert.upsert(old, new, TABLES["requests_by_date"].keys)


def _upsert_touched(spark, d):
    """The new content of the dates the snapshot touches (what a dynamic
    partition overwrite writes)."""
    old, new = _snapshots(spark, d)
    return upsert.upsert_partitions(old, new, TABLES["requests_by_date"].keys, "date")


def _quality(spark, d):
    dims = {"packages": T.packages(spark, d), "client_types": T.client_types(spark)}
    frames = {
        "packages": dims["packages"],
        "requests_by_date": T.requests_by_date(spark, d),
        "requests_by_region_date": T.requests_by_region_date(spark, d),
        "systems_by_date": T.systems_by_date(spark, d),
        "versions_by_date": T.versions_by_date(spark, d),
        "requests_total": T.requests_total(spark, d),
    }
    out = None
    for name, frame in frames.items():
        part = quality.violations(frame, TABLES[name], dims)
        out = part if out is None else out.unionByName(part)
    return out


def _summary_table(spark, d):
    return summary.last_month_summary(_by_date(spark, d))


def _chart_series(spark, d):
    totals = reports.requests_by(_by_region(spark, d), ["region", "date"], order=None)
    series = as_series(totals, "region")
    return series.select("region", F.size("points").cast("bigint").alias("n_points"), F.to_json("points").alias("points_json"))


def _package_region_series(spark, d):
    totals = reports.package_requests_by(_by_region(spark, d), T.packages(spark, d), ["region", "date"])
    series = as_series(totals, ["package_key", "region"])
    return series.select(
        "package_key", "region", F.size("points").cast("bigint").alias("n_points"), F.to_json("points").alias("points_json")
    )


def _update_job(spark, d):
    """The whole update job, twice, from CSV part files in the shared folder.

    The first run loads all but the last ten days, with failed requests
    counted as good ones, for the first registry; the second one the correct
    feeds, with one more registry. Returns the rows of all eight tables."""
    root = f"{shared_dir(spark)}/update_job/{uuid.uuid4().hex}"
    log = T.package_feed(spark, d)
    feeds = {
        "package_requests": log,
        "package_requests_by_date": log,
        "package_requests_by_region_by_date": log,
        "systems_by_date": T.systems_feed(spark, d),
        "versions_by_date": T.versions_feed(spark, d),
    }
    cut = F.date_sub(log.select(F.max("date")).scalar(), 10)
    early = {name: feed.where(F.col("date") <= cut) for name, feed in feeds.items()}
    early = {n: f.withColumn("status", F.lit(200)) if "status" in f.columns else f for n, f in early.items()}
    registered = T.packages(spark, d).select("package_uuid", "package_name")

    def csv(run: str, name: str, frame: DataFrame) -> str:
        path = f"{root}/{run}/{name}"
        frame.repartition(3).write.option("header", True).csv(path)
        return path

    first, second = csv("in1", "registry1", registered), csv("in2", "registry2", _registry_extracts(spark, d)[1])
    limits = {"region": LONGEST_REGION}
    run_update(spark, f"{root}/tables", {n: csv("in1", n, f) for n, f in early.items()}, [first], max_lengths=limits)
    run_update(spark, f"{root}/tables", {n: csv("in2", n, f) for n, f in feeds.items()}, [first, second], max_lengths=limits)
    out = None
    for name, label in (
        ("packages", F.concat_ws(" ", "package_uuid", "package_name")),
        ("client_types", F.col("client_type")),
        ("requests_total", F.lit("")),
        ("requests_by_date", F.lit("")),
        ("requests_by_region_date", F.col("region")),
        ("systems_by_date", F.col("system")),
        ("versions_by_date", F.col("version")),
        ("requests_last_month", F.lit("")),
    ):
        rows, spec = read_table(spark, name, f"{root}/tables"), TABLES[name]
        has = lambda c, none, cols=spec.columns: F.col(c) if c in cols else F.lit(none)
        part = rows.select(
            F.lit(name).alias("table_name"),
            has("package_id", 0).alias("package_id"),
            has("client_type_id", 0).alias("client_type_id"),
            label.alias("label"),
            has("date", "").cast("string").alias("date"),
            (F.col(spec.measure) if spec.measure else F.lit(0)).cast("bigint").alias("n"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _system_labels(spark, d):
    systems = T.systems_by_date(spark, d).select("system").distinct()
    return systems.select(
        "system",
        system_label("system", "Full").alias("full_label"),
        system_label("system", "CPU Arch").alias("arch"),
        system_label("system", "OS").alias("os"),
    )


def _stream_ingest(spark, d):
    """Structured Streaming: the event log as a file stream, each micro-batch
    ingested and upserted into a date-partitioned table; the table is read
    back once the available input is processed."""
    root = f"{shared_dir(spark)}/stream_ingest/{uuid.uuid4().hex}"
    pk, ct = T.packages(spark, d), T.client_types(spark)

    def to_feed(batch: DataFrame) -> DataFrame:
        return T.raw_requests_from_events(batch, T.table(spark, d, "region"), carry=SNAPSHOT_COLS)

    def transform(feed: DataFrame, carry) -> DataFrame:
        return ingest.ingest_requests_by_date(feed, pk, ct, carry=carry)

    events = T.table(spark, d, "events")
    # a file stream watches a folder: that of the table's part files, or of its one file
    source, options = f"{d.rstrip('/')}/events.parquet", {}
    if events.inputFiles()[0].endswith("/events.parquet"):
        source, options = d.rstrip("/"), {"pathGlobFilter": "events.parquet"}
    run_snapshot_ingest(
        spark,
        source=source,
        source_format="parquet",
        source_schema=events.schema,
        to_feed=to_feed,
        transform=transform,
        spec=TABLES["requests_by_date"],
        table_root=f"{root}/tables",
        options=options,
        checkpoint=f"{root}/checkpoint",
        dims={"packages": pk, "client_types": ct},
    )
    return spark.read.parquet(f"{root}/tables/requests_by_date").select(*TABLES["requests_by_date"].columns)


def _keep_last_feed_order(spark, d) -> DataFrame:
    """Of the feed rows that share a truncated platform, the last one by the
    feed's row order: the systems feed in an order that has nothing to do with
    its strings, written as CSV part files and read back with positions."""
    path = f"{shared_dir(spark)}/feed_order/{uuid.uuid4().hex}"
    feed = T.systems_feed(spark, d)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (SYSTEM_FEED_COLUMN, "client_type", "date")]
    shuffled = feed.withColumn("mixed", F.md5(F.concat_ws("|", *parts)))
    shuffled.repartitionByRange(5, "mixed").sortWithinPartitions("mixed").write.option("header", True).csv(path)
    rows = read_feed(spark, "systems_by_date", path, position=True)
    return ingest.ingest_systems_by_date(rows, T.client_types(spark), combine="last", order_col=POSITION)


def _quality_rejects(spark, d) -> DataFrame:
    """The rejected rows of a feed with broken values, as text, one by one."""
    path = f"{shared_dir(spark)}/rejects/{uuid.uuid4().hex}"
    log = T.raw_requests(spark, d)
    kind = F.col("event_id") % 40
    broken = log.select(
        "package_uuid",
        "client_type",
        F.when(kind == 1, F.lit("ok")).when(kind != 2, F.col("status").cast("string")).alias("status"),
        F.when(kind == 3, F.lit("2024-02-30")).otherwise(F.col("date").cast("string")).alias("date"),
        F.when(kind == 4, F.lit("2147483648")).when(kind == 5, F.lit("-1")).otherwise(F.lit("1")).alias("request_count"),
        "event_id",
    )
    broken.repartition(3).write.option("header", True).csv(path)
    _, rejects = read_feed_checked(spark, "package_requests_by_date", path, required=("status", "request_count"))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return rejects.select(
        "feed",
        "reason",
        field("event_id").cast("bigint").alias("event_id"),
        field("package_uuid").alias("package_uuid"),
        field("status").alias("status"),
        field("date").alias("date"),
        field("request_count").alias("request_count"),
    )


def _stored(spark, d, name: str) -> str:
    """A fact table loaded twice: at first without the last ten days and with
    failed requests counted as good ones, then whole. Returns its folder."""
    root = f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}"
    load = {"requests_by_date": ingest.ingest_requests_by_date, "requests_by_region_date": ingest.ingest_requests_by_region_date}[name]
    feed, pk, ct = T.package_feed(spark, d), T.packages(spark, d), T.client_types(spark)
    cut = F.date_sub(feed.select(F.max("date")).scalar(), 10)
    spec, dims = TABLES[name].limited({"region": LONGEST_REGION}), {"packages": pk, "client_types": ct}
    merge_into_table(spark, load(feed.where(F.col("date") <= cut).withColumn("status", F.lit(200)), pk, ct), spec, root, dims)
    merge_into_table(spark, load(feed, pk, ct), spec, root, dims)
    return root


def _ledger_by_date(spark, d) -> DataFrame:
    """What the commits of two loads recorded per date: the rows of the table
    (old keys stay) and of the feed that last changed it."""
    ledger = read_ledger(spark, TABLES["requests_by_date"], _stored(spark, d, "requests_by_date"))
    return ledger.select("date", "table_rows", "feed_rows")


def _top_month_stored(spark, d) -> DataFrame:
    """The top list over the stored table: its as-of date comes from the ledger."""
    stored = read_table(spark, "requests_by_date", _stored(spark, d, "requests_by_date"))
    return reports.top_packages(stored, T.packages(spark, d), "1 month", client_types=(1, 2, 3))


def _package_alpha_stored(spark, d) -> DataFrame:
    """One package's regions over the stored table, its ids looked up first."""
    stored = read_table(spark, "requests_by_region_date", _stored(spark, d, "requests_by_region_date"))
    packages = T.packages(spark, d)
    ids = reports.ids_of(packages, "ALPHA")
    return reports.package_share_by(stored, packages, "region", "ALPHA", package_ids=ids)


def _top_page_display(spark, d) -> DataFrame:
    """The month's top list under the page's column titles."""
    return reports.display(_top("1 month")(spark, d).drop("total_requests"))


def _summary_incremental(spark, d) -> DataFrame:
    """The monthly summary after a second load over five months, from the
    first one's: only dates that came, changed or left the window are read."""
    spec, whole = TABLES["requests_by_date"], T.spread_tables(spark, d)["requests_by_date"]
    last = whole.select(F.max("date")).first()[0]
    cut = last - datetime.timedelta(days=10)
    # the first load lacks the last ten days, and counts every fourth day wrong
    wrong = F.when(F.dayofmonth("date") % 4 == 0, 1).otherwise(0)
    first = whole.where(F.col("date") <= F.lit(cut)).withColumn("request_count", F.col("request_count") + wrong)
    changed = [r[0] for r in digests(whole, spec).subtract(digests(first, spec)).select("date").collect()]
    asof = first.select(F.max("date")).first()[0]
    window = F.col("date") > parse_timeframe(summary.SUMMARY_WINDOW).lower_bound(F.lit(asof))
    state = summary.summary_state(first.where(window))
    return summary.advance_summary(state, first, whole, changed, asof, last).drop("n_rows")


def _kpis_by_prefix(spark, d) -> DataFrame:
    """Every package's totals of five windows, from running totals over 150 dates."""
    running = summary.running_totals(T.spread_tables(spark, d)["requests_by_date"])
    windows = {"past_1d": "1d", "past_7d": "7d", "past_30d": "30d", "past_120d": "120d", "all_time": "all"}
    return summary.window_totals(running, T.packages(spark, d), windows)


def _package_name_history(spark, d) -> DataFrame:
    """Names by successive registry extracts: on each date the packages that
    users with a purchase asked for, under names that change twice a month."""
    ev = T.table(spark, d, "events").where("event_type = 'purchase'")
    date = F.to_date("ts")
    turn = F.floor(F.dayofmonth(date) / 11).cast("string")
    uuids = F.concat(F.lit("uuid-"), (F.col("user_id") % 97).cast("string"))
    extracts = ev.select(date.alias("extract_date"), uuids.alias("package_uuid"), F.concat(uuids, F.lit("-"), turn).alias("package_name"))
    return dimensions.name_history(extracts.distinct())


def _stream_parts(spark, d) -> DataFrame:
    """Two snapshots of the log as three part files each, in two micro-batches:
    the first snapshot (without the last ten days) is whole at first, of the
    second only two files are there; the third and its marker come later."""
    root = f"{shared_dir(spark)}/stream_parts/{uuid.uuid4().hex}"
    pk, ct, events = T.packages(spark, d), T.client_types(spark), T.table(spark, d, "events")
    day = F.to_date("ts")
    for name, part in (("s1", events.where(day <= F.date_sub(events.select(F.max(day)).scalar(), 10))), ("s2", events)):
        part.repartition(3, "event_id").write.parquet(f"{root}/outside/{name}")
    files = [f for f in versions.names(spark, f"{root}/outside/s2") if f.startswith("part-")]

    def arrive(*names: str) -> None:
        for name in names:
            versions.move(spark, f"{root}/outside/{name}", f"{root}/landing/{name}")

    def run() -> None:
        run_snapshot_ingest(
            spark,
            source=f"{root}/landing",
            source_format="parquet",
            source_schema=events.schema,
            to_feed=lambda batch: T.raw_requests_from_events(batch, T.table(spark, d, "region"), carry=SNAPSHOT_COLS),
            transform=lambda feed, carry: ingest.ingest_requests_by_date(feed, pk, ct, carry=carry),
            spec=TABLES["requests_by_date"],
            table_root=f"{root}/tables",
            options={"recursiveFileLookup": "true"},
            checkpoint=f"{root}/checkpoint",
            dims={"packages": pk, "client_types": ct},
            marker="_SUCCESS",
        )

    arrive("s1", *(f"s2/{f}" for f in files[:-1]))
    run()
    arrive(f"s2/{files[-1]}", "s2/_SUCCESS")
    run()
    return read_table(spark, "requests_by_date", f"{root}/tables")


def _spread_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Reports over a log of 150 dates: every window leaves rows out."""

    def on(table: str, report: Callable[[DataFrame, DataFrame], DataFrame]):
        return lambda s, d: report(T.spread_tables(s, d)[table], T.packages(s, d))

    def downloads(s, d):
        month = summary.last_month_summary(T.spread_tables(s, d)["requests_by_date"])
        return summary.monthly_downloads(month, T.packages(s, d), _lookup_names(s, d))

    R, by_date, by_region = reports, "requests_by_date", "requests_by_region_date"
    return {
        "spread_totals_30d": on(by_date, lambda t, p: R.requests_by(t, ["date"])),
        "spread_totals_60d": on(by_date, lambda t, p: R.requests_by(t, ["date"], "60d")),
        "spread_totals_120d": on(by_date, lambda t, p: R.requests_by(t, ["date"], "120d")),
        "spread_totals_all": on(by_date, lambda t, p: R.requests_by(t, ["date"], "all", (1, 2, 3))),
        "spread_version_share": on("versions_by_date", lambda t, p: R.share_by(t, "version", "60d")),
        "spread_region_share": on(by_region, lambda t, p: R.share_by(t, "region", "120d")),
        "spread_systems": on("systems_by_date", lambda t, p: R.systems_by(t, "Full")),
        "spread_top_month": on(by_date, lambda t, p: R.top_packages(t, p, "1 month")),
        "spread_kpis": on(by_date, lambda t, p: R.request_kpis(t)),
        "spread_package_by_date": on(by_date, R.package_daily),
        "spread_package_region_share": on(by_region, lambda t, p: R.package_share_by(t, p, "region")),
        "spread_summary_last_month": on(by_date, lambda t, p: summary.last_month_summary(t)),
        "spread_monthly_downloads": downloads,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    R = reports
    return {
        # ingest (raw feed -> curated tables)
        "ingest_total": lambda s, d: T.requests_total(s, d),
        "ingest_by_date": lambda s, d: T.requests_by_date(s, d),
        "ingest_by_region_date": lambda s, d: T.requests_by_region_date(s, d),
        "ingest_systems": lambda s, d: T.systems_by_date(s, d),
        "ingest_versions": lambda s, d: T.versions_by_date(s, d),
        "keep_last": lambda s, d: T.systems_by_date(s, d, combine="last"),
        "insert_absent": _insert_absent,
        "upsert_replace": _upsert_replace,
        "upsert_touched_partitions": _upsert_touched,
        "quality_violations": _quality,
        # top / trending
        "top_month": _top("1 month"),
        "top_week": _top("7 day"),
        "top_day": _top("1 day"),
        "trending": lambda s, d: R.trending_packages(_by_date(s, d), T.packages(s, d)),
        "trending_all_clients": lambda s, d: R.trending_packages(
            _by_date(s, d), T.packages(s, d), client_types=(1, 2, 3)
        ),
        # all-package series
        "totals_by_date": lambda s, d: R.requests_by(_by_date(s, d), ["date"]),
        "totals_by_toggles": _totals_by_toggles,
        "totals_all_time": lambda s, d: R.requests_by(_by_date(s, d), ["date"], "all", (1, 2, 3)),
        "versions_by_date": lambda s, d: R.requests_by(T.versions_by_date(s, d), ["version", "date"]),
        "version_share": lambda s, d: R.share_by(T.versions_by_date(s, d), "version"),
        "regions_by_date": lambda s, d: R.requests_by(_by_region(s, d), ["region", "date"]),
        "region_share": lambda s, d: R.share_by(_by_region(s, d), "region"),
        "systems_full": lambda s, d: R.systems_by(T.systems_by_date(s, d), "Full"),
        "systems_arch": lambda s, d: R.systems_by(T.systems_by_date(s, d), "CPU Arch"),
        "systems_os": lambda s, d: R.systems_by(T.systems_by_date(s, d), "OS"),
        "system_share": lambda s, d: R.system_share(T.systems_by_date(s, d), "Full"),
        "system_labels": _system_labels,
        "kpis_all": lambda s, d: R.request_kpis(_by_date(s, d)),
        "kpis_by_package": lambda s, d: R.request_kpis(_by_date(s, d), packages=T.packages(s, d), by_package=True),
        # per-package pages (batch form: every package at once)
        "package_by_date": lambda s, d: R.package_daily(_by_date(s, d), T.packages(s, d)),
        "package_alpha_by_date": lambda s, d: R.package_daily(_by_date(s, d), T.packages(s, d), "ALPHA"),
        "package_by_region": lambda s, d: R.package_requests_by(_by_region(s, d), T.packages(s, d), ["region", "date"]),
        "package_region_share": lambda s, d: R.package_share_by(_by_region(s, d), T.packages(s, d), "region"),
        # summary table, API lookups, badges
        "summary_last_month": _summary_table,
        "monthly_downloads": lambda s, d: summary.monthly_downloads(
            _summary_table(s, d), T.packages(s, d), _lookup_names(s, d)
        ),
        "total_downloads": lambda s, d: summary.total_downloads(
            T.requests_total(s, d), T.packages(s, d), _lookup_names(s, d)
        ),
        "badge_markdown": lambda s, d: summary.badges(T.packages(s, d)),
        "cleanse_name": lambda s, d: T.table(s, d, "pages").select(
            "page_id", cleanse_name("url").alias("cleansed")
        ),
        "cleanse_props": lambda s, d: T.table(s, d, "events").select(
            "event_id", cleanse_name("props").alias("cleansed")
        ),
        "chart_series": _chart_series,
        "url_contains": lambda s, d: T.table(s, d, "pages")
        .where(url_contains("url", "example.org/"))
        .select("page_id", "url"),
        "package_region_series": _package_region_series,
        "top_page_display": _top_page_display,
        # loads: feed order, rejected rows, stored tables and their ledger, name history
        "keep_last_feed_order": _keep_last_feed_order,
        "quality_rejects": _quality_rejects,
        "ledger_by_date": _ledger_by_date,
        "top_month_stored": _top_month_stored,
        "package_alpha_stored": _package_alpha_stored,
        "package_name_history": _package_name_history,
        "summary_incremental": _summary_incremental,
        "kpis_by_prefix": _kpis_by_prefix,
        # the whole job, and streaming
        "update_job": _update_job,
        "stream_ingest": _stream_ingest,
        "stream_parts": _stream_parts,
        # windows over a longer log
        **_spread_queries(),
        **(llm.queries() if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | (llm.oracle_sql() if llm else {})
