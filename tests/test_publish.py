"""Versioned publish, the ledger of dates, clustered files, and waiting snapshots."""

import contextlib
import glob
import io
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pkgpulse.operators import ingest
from pkgpulse.plans import dimensions, reports, tables
from pkgpulse.plans.tables import QualityError, merge_into_table, replace_table
from pkgpulse.plans.update import RejectedError, run_update
from pkgpulse.schemas import TABLES
from pkgpulse.sources import versions
from pkgpulse.sources.registry import client_types_frame
from pkgpulse.sources.snapshots import POSITION, read_feed, read_feed_checked, read_ledger, read_table
from pkgpulse.streaming.snapshots import run_snapshot_ingest
from tests.helpers import D, rows

PACKAGES, TOTAL, BY_DATE = (TABLES[n] for n in ("packages", "requests_total", "requests_by_date"))


def packages(spark, *listed):
    return spark.createDataFrame(list(listed), PACKAGES.schema)


def facts(spark, *listed):
    return spark.createDataFrame(list(listed), BY_DATE.schema)


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f)}


def csv(path, header, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join([header, *lines]) + "\n")
    return path


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


# ------------------------------------------------------- versioned publish


def test_a_writer_that_stops_half_way_leaves_the_old_table(spark, scratch):
    root = f"{scratch}/wh"
    replace_table(spark, packages(spark, (1, "u1", "A"), (2, "u2", "B")), PACKAGES, root)
    many = spark.range(20_000).repartition(8)
    boom = F.when(F.col("id") == 19_999, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("x"))
    half = many.select(F.col("id").cast("int").alias("package_id"), F.col("id").cast("string").alias("package_uuid"), boom.alias("package_name"))
    with pytest.raises(Exception, match="lost"):
        replace_table(spark, half, PACKAGES, root)
    assert rows(read_table(spark, PACKAGES, root)) == [(1, "u1", "A"), (2, "u2", "B")]
    # the next writer goes on as if nothing had been, and clears what was left
    replace_table(spark, packages(spark, (3, "u3", "C")), PACKAGES, root)
    assert rows(read_table(spark, PACKAGES, root)) == [(3, "u3", "C")]
    assert len(glob.glob(f"{root}/packages/v=*")) == 2  # the new version and its predecessor


def test_a_crash_before_the_pointer_changes_nothing(spark, scratch, monkeypatch):
    root = f"{scratch}/wh"
    replace_table(spark, packages(spark, (1, "u1", "A")), PACKAGES, root)

    def stop(*_):
        raise SystemError("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "put_text", stop)
        with pytest.raises(SystemError):
            replace_table(spark, packages(spark, (1, "u1", "Z")), PACKAGES, root)
    assert rows(read_table(spark, PACKAGES, root)) == [(1, "u1", "A")]


def test_a_failed_check_publishes_nothing(spark, scratch):
    root = f"{scratch}/wh"
    replace_table(spark, packages(spark, (1, "u1", "A")), PACKAGES, root)
    with pytest.raises(QualityError):
        replace_table(spark, packages(spark, (1, "u1", "A"), (1, "u2", "B")), PACKAGES, root)
    assert rows(read_table(spark, PACKAGES, root)) == [(1, "u1", "A")]


def test_readers_keep_the_version_that_they_opened(spark, scratch):
    root = f"{scratch}/wh"
    replace_table(spark, packages(spark, (1, "u1", "A")), PACKAGES, root)
    opened = read_table(spark, PACKAGES, root)
    replace_table(spark, packages(spark, (1, "u1", "B")), PACKAGES, root)
    assert rows(opened) == [(1, "u1", "A")] and rows(read_table(spark, PACKAGES, root)) == [(1, "u1", "B")]


def test_a_plain_folder_is_read_and_then_versioned(spark, scratch):
    root = f"{scratch}/wh"
    spark.createDataFrame([(1, 1, 5)], TOTAL.schema).write.parquet(f"{root}/requests_total")
    merge_into_table(spark, spark.createDataFrame([(2, 1, 7)], TOTAL.schema), TOTAL, root)
    assert rows(read_table(spark, TOTAL, root)) == [(1, 1, 5), (2, 1, 7)]
    assert not glob.glob(f"{root}/requests_total/part-*")


# ------------------------------------------------------------------ ledger


def test_an_identical_rerun_writes_nothing_although_old_keys_stay(spark, scratch):
    root = f"{scratch}/wh"
    for spec, old, new in (
        (BY_DATE, [(1, 1, D(2024, 1, 1), 1), (9, 1, D(2024, 1, 2), 4)], [(1, 1, D(2024, 1, 1), 1), (1, 1, D(2024, 1, 2), 3)]),
        (TOTAL, [(1, 1, 1), (9, 1, 4)], [(1, 1, 3)]),
    ):
        merge_into_table(spark, spark.createDataFrame(old, spec.schema), spec, root)
        feed = spark.createDataFrame(new, spec.schema)
        merge_into_table(spark, feed, spec, root)
        # the table holds key 9, which the feed lacks
        assert 9 in [r[0] for r in rows(read_table(spark, spec, root))]
        before = files(root)
        merge_into_table(spark, feed, spec, root)
        assert files(root) == before
        changed = spark.createDataFrame([(*new[0][:-1], 50)], spec.schema)
        merge_into_table(spark, changed, spec, root)
        assert files(root) != before and 50 in [r[-1] for r in rows(read_table(spark, spec, root))]


def test_ledger_holds_rows_of_table_and_feed(spark, scratch):
    root = f"{scratch}/wh"
    merge_into_table(spark, facts(spark, (1, 1, D(2024, 1, 1), 1), (2, 1, D(2024, 1, 1), 2), (1, 1, D(2024, 1, 3), 1)), BY_DATE, root)
    merge_into_table(spark, facts(spark, (3, 1, D(2024, 1, 1), 5)), BY_DATE, root)
    ledger = read_ledger(spark, BY_DATE, root).select("date", "table_rows", "feed_rows")
    assert rows(ledger) == [(D(2024, 1, 1), 3, 1), (D(2024, 1, 3), 1, 1)]


def test_the_asof_date_opens_no_file_of_the_table(spark, scratch):
    root = f"{scratch}/wh"
    pk = packages(spark, (1, "u1", "A"))
    merge_into_table(spark, facts(spark, *[(1, 1, D(2024, 1, d), d) for d in range(1, 20)]), BY_DATE, root)
    stored = read_table(spark, BY_DATE, root)
    report = reports.top_packages(stored, pk, "7 day")
    assert [r["total_requests"] for r in report.collect()] == [sum(range(13, 20))]
    text = plan(report)
    main, subqueries = text.split("===== Subqueries =====")
    assert "_ledger/requests_by_date" in subqueries and f"{root}/requests_by_date" not in subqueries
    assert "PartitionFilters" in main and "Subquery subquery" in main
    # a date whose commit has not reached the ledger does not show
    ahead = facts(spark, (1, 1, D(2024, 1, 25), 1000))
    tables.commit(ahead, BY_DATE, root)
    report = reports.top_packages(read_table(spark, BY_DATE, root), pk, "7 day")
    assert [r["total_requests"] for r in report.collect()] == [sum(range(13, 20))]
    # the next load finds it missing there, and brings it in
    merge_into_table(spark, ahead, BY_DATE, root)
    report = reports.top_packages(read_table(spark, BY_DATE, root), pk, "7 day")
    assert [r["total_requests"] for r in report.collect()] == [1000 + 19]


def test_a_table_of_before_the_ledger_is_counted_once(spark, scratch):
    root = f"{scratch}/wh"
    old = facts(spark, (1, 1, D(2024, 1, 1), 1), (1, 1, D(2024, 2, 1), 1))
    old.write.partitionBy("date").parquet(f"{root}/requests_by_date")
    assert reports.requests_by(read_table(spark, BY_DATE, root), ["date"]).count() == 1
    merge_into_table(spark, facts(spark, (1, 1, D(2024, 1, 1), 8)), BY_DATE, root)
    assert rows(read_ledger(spark, BY_DATE, root).select("date", "table_rows")) == [(D(2024, 1, 1), 1), (D(2024, 2, 1), 1)]


# ------------------------------------------------------- clustered layout


def test_one_package_reads_few_row_groups(spark, scratch):
    root, spec = f"{scratch}/wh", BY_DATE
    fact = spark.range(60_000).select(
        (F.col("id") % 20_000).cast("int").alias("package_id"),
        F.lit(1).alias("client_type_id"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") / 20_000).cast("int")).alias("date"),
        F.lit(1).cast("bigint").alias("request_count"),
    )
    spark.conf.set("parquet.block.size", "16384")
    try:
        merge_into_table(spark, fact.repartition(7), spec, root)
    finally:
        spark.conf.unset("parquet.block.size")
    pk = packages(spark, (4321, "u1", "Alpha"), (7, "u2", "ALPHA"), (8, "u3", "Beta"))
    ids = reports.ids_of(pk, "alpha")
    assert ids == [7, 4321] and reports.ids_of(pk, "alpha", most=1) is None and reports.ids_of(pk, "none") == []
    report = reports.package_daily(read_table(spark, spec, root), pk, "alpha", package_ids=ids)
    assert [r["total_requests"] for r in report.collect()] == [2, 2, 2]
    pushed = [line for line in plan(report).split("\n") if line.startswith("PushedFilters")]
    assert any("In(package_id, [4321,7])" in line or "In(package_id, [7,4321])" in line for line in pushed), pushed
    touched = total = 0
    for name in glob.glob(f"{root}/requests_by_date/date=*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(0)
            assert column.path_in_schema == "package_id"
            stats = column.statistics
            total += 1
            touched += any(stats.min <= i <= stats.max for i in ids)
    assert total >= 12 and touched <= total / 2
    assert reports.package_daily(read_table(spark, spec, root), pk, "none", package_ids=[]).collect() == []


# ------------------------------------------------------------- feed order


def test_last_row_of_the_feed_wins(spark, scratch):
    header = "julia_system,client_type,date,request_count"
    feed = f"{scratch}/in/systems"
    csv(f"{feed}/a.csv", header, ["x86_64-linux-musl,user,2024-03-31,4", "x86_64-linux-gnu,user,2024-03-31,3"])
    csv(f"{feed}/b.csv", header, ["aarch64-linux-z,user,2024-03-31,1", "aarch64-linux-a,user,2024-03-31,2"])
    got = read_feed(spark, "systems_by_date", feed, position=True)
    systems = ingest.ingest_systems_by_date(got, client_types_frame(spark), combine="last", order_col=POSITION)
    want = [("aarch64-linux", 1, D(2024, 3, 31), 2), ("x86_64-linux", 1, D(2024, 3, 31), 3)]
    assert rows(systems) == want
    run_update(spark, f"{scratch}/wh", {"systems_by_date": feed}, combine="last")
    assert rows(read_table(spark, "systems_by_date", f"{scratch}/wh")) == want


# ------------------------------------------------------------- quarantine


def test_rejected_rows_are_kept_and_the_load_goes_on(spark, scratch):
    path = csv(
        f"{scratch}/in/by_date.csv",
        "package_uuid,client_type,status,date,request_count,more",
        ["u1,user,200,2024-03-30,4,a", "u1,user,200,2024-13-31,6,b", "u1,user,200,2024-03-31,2147483648,c", "u1,user,,2024-03-31,1,d", "u1,user,200"],
    )
    good, rejects = read_feed_checked(spark, "package_requests_by_date", path, ("status", "request_count"))
    assert [r.package_uuid for r in good.collect()] == ["u1"] and good.columns[-1] == "more"
    assert sorted(r.reason for r in rejects.collect()) == ["cast:date", "malformed", "null:status", "range:request_count"]
    assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {"by_date.csv"}
    registry = spark.createDataFrame([("u1", "Foo")], "package_uuid string, package_name string")
    feeds, root = {"package_requests_by_date": path}, f"{scratch}/wh"
    with pytest.raises(Exception):  # noqa: B017 - without a share every such row fails the load
        run_update(spark, root, feeds, [registry])
    with pytest.raises(RejectedError, match="4 of 5 rows"):
        run_update(spark, root, feeds, [registry], max_rejects=0.5)
    run_update(spark, root, feeds, [registry], max_rejects=0.8)
    assert rows(read_table(spark, BY_DATE, root)) == [(1, 1, D(2024, 3, 30), 4)]
    assert spark.read.parquet(f"{root}/_rejects/package_requests_by_date/*").count() == 8  # of both loads
    clean = csv(f"{scratch}/in2/c.csv", "package_uuid,client_type,status,date,request_count", ["u1,user,200,2024-04-01,1"])
    run_update(spark, f"{scratch}/wh2", {"package_requests_by_date": clean}, [registry], max_rejects=0.0)
    assert not glob.glob(f"{scratch}/wh2/_rejects/package_requests_by_date/*")


def test_name_history_has_gaps_and_returns(spark):
    listed = [(1, "u", "A"), (2, "u", "A"), (3, "u", "B"), (5, "u", "B"), (6, "u", "A"), (6, "u", "Z"), (1, "v", "V"), (4, "w", "W")]
    extracts = spark.createDataFrame([(D(2024, 1, d), u, n) for d, u, n in listed], "extract_date date, package_uuid string, package_name string")
    got = rows(dimensions.name_history(extracts), "package_uuid", "package_name", "valid_from", "last_listed", "valid_to")
    day = lambda d: d and D(2024, 1, d)
    want = [("u", "A", 1, 2, 3), ("u", "A", 6, 6, None), ("u", "B", 3, 3, 4), ("u", "B", 5, 5, 6), ("v", "V", 1, 1, 2), ("w", "W", 4, 4, 5)]
    assert got == [(u, n, *map(day, d)) for u, n, *d in want]


# --------------------------------------------------------- waiting snapshots


def test_snapshots_wait_for_their_marker(spark, scratch):
    src, header = f"{scratch}/landing", "julia_version_prefix,client_type,date,request_count"
    line = lambda n, day=31: [f"1.9.{n},user,2024-03-{day},{n}"]

    def load():
        run_snapshot_ingest(
            spark,
            source=src,
            source_format="csv",
            source_schema=spark.createDataFrame([], "julia_version_prefix string, client_type string, date date, request_count bigint").schema,
            to_feed=lambda b: b,
            transform=lambda feed, carry: ingest.ingest_versions_by_date(feed, client_types_frame(spark), carry=carry),
            spec=TABLES["versions_by_date"],
            table_root=f"{scratch}/tables",
            checkpoint=f"{scratch}/chk",
            options={"header": "true", "recursiveFileLookup": "true"},
            marker="_SUCCESS",
        )
        got = read_table(spark, "versions_by_date", f"{scratch}/tables", absent_ok=True)
        return {r["date"].day: r["request_count"] for r in got.collect()}

    def put(name, lines, at):
        os.utime(csv(f"{src}/{name}", header, lines), (at, at))

    put("s1/a.csv", line(1), 1000)
    put("s1/b.csv", line(2) + line(5, 30), 1000)
    assert load() == {}  # nothing is whole yet
    put("s2/a.csv", line(10), 2000)
    open(f"{src}/s2/_SUCCESS", "w").close()
    assert load() == {31: 10}  # the second snapshot overtakes the first
    put("s1/c.csv", line(4), 1000)
    assert load() == {31: 10}
    open(f"{src}/s1/_SUCCESS", "w").close()  # a marker that comes alone
    assert load() == {30: 5, 31: 10}  # the older snapshot fills in, the newer one still wins
    put("s2/late.csv", line(7), 2000)
    assert load() == {30: 5, 31: 17}  # a late part: its snapshot is summed anew
    assert load() == {30: 5, 31: 17}


# ------------------------------------------------- summary and running totals


def test_summary_advances_like_a_full_recompute(spark):
    from pkgpulse.plans import summary

    before = [(1, 1, D(2024, 2, 20), 5), (2, 1, D(2024, 3, 1), 7), (3, 1, D(2024, 3, 15), 0), (4, 1, D(2024, 3, 20), 2)]
    after = [*before[:3], (4, 1, D(2024, 3, 20), 9), (3, 2, D(2024, 3, 20), 1), (1, 1, D(2024, 4, 5), 4)]
    old, new = facts(spark, *before), facts(spark, *after)
    state = summary.summary_state(old.where(F.col("date") > "2024-02-20"))
    got = summary.advance_summary(state, old, new, [D(2024, 3, 20), D(2024, 4, 5)], D(2024, 3, 20), D(2024, 4, 5))
    # 03-01 is left behind; a key whose total is zero stays while it has a row
    assert rows(got.drop("n_rows")) == [(1, 1, 4), (3, 1, 0), (3, 2, 1), (4, 1, 9)]
    assert rows(got.drop("n_rows")) == rows(summary.last_month_summary(new))
    with pytest.raises(ValueError, match="goes back"):
        summary.advance_summary(state, old, new, [], D(2024, 3, 20), D(2024, 3, 19))


def test_running_totals_carry_over_missing_days(spark):
    from pkgpulse.plans import summary

    by_date = facts(spark, (1, 1, D(2024, 1, 1), 5), (1, 1, D(2024, 1, 4), 2), (2, 1, D(2024, 1, 5), 1), (1, 2, D(2024, 1, 5), 50))
    running = summary.running_totals(by_date)
    assert rows(running.where("package_id = 1 and client_type_id = 1"), "date", "running") == [
        (D(2024, 1, d), n) for d, n in ((1, 5), (2, 5), (3, 5), (4, 7), (5, 7))
    ]
    pk = packages(spark, (1, "u1", "A"), (2, "u2", "a"), (3, "u3", "None"))
    got = summary.window_totals(running, pk, {"one": "1d", "two": "2d", "all": "all"})
    assert rows(got) == [("a", 1, 3, 8), ("none", 0, 0, 0)]
