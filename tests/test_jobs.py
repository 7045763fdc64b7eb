"""Update job from CSV feeds, staged commits, and the streaming ingest."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pkgpulse.plans.tables import QualityError, merge_into_table
from pkgpulse.plans.update import run_update
from pkgpulse.schemas import REQUESTS_BY_REGION_DATE, TABLES
from pkgpulse.session import shared_dir
from pkgpulse.sources.snapshots import read_feed, read_table
from pkgpulse.streaming.snapshots import SNAPSHOT_COLS, run_snapshot_ingest
from pkgpulse.operators import ingest
from tests.helpers import D, rows


def _csv(path, header, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(header + "\n" + "\n".join(lines) + "\n")
    return path


def _feeds(base):
    return {
        "package_requests": _csv(
            f"{base}/package_requests.csv",
            "package_uuid,client_type,status,request_addrs,request_count,cache_misses",
            ["u1,user,200,3,10,0", "u1,,200,1,2,0", "u2,ci,500,1,99,0", "u9,user,200,1,5,0"],
        ),
        "package_requests_by_date": _csv(
            f"{base}/package_requests_by_date.csv",
            "package_uuid,client_type,status,date,request_count",
            ["u1,user,200,2024-03-30,4", "u1,user,200,2024-03-31,6", "u2,ci,200,2024-03-31,1"],
        ),
        "package_requests_by_region_by_date": _csv(
            f"{base}/package_requests_by_region_by_date.csv",
            "package_uuid,client_type,status,region,date,request_count",
            ["u1,user,200,eu,2024-03-31,6", "u2,ci,200,us,2024-03-31,1"],
        ),
        "systems_by_date": _csv(
            f"{base}/systems.csv",
            "julia_system,client_type,date,request_count",
            ["x86_64-linux-gnu,user,2024-03-31,3", "x86_64-linux-musl,user,2024-03-31,4", "aarch64-apple-darwin,,2024-03-31,9"],
        ),
        "versions_by_date": _csv(
            f"{base}/versions.csv",
            "julia_version_prefix,client_type,date,request_count",
            ["1.10.4,user,2024-03-31,3", "1.10.5,user,2024-03-31,1", "1.9.0,ci,2024-03-31,2"],
        ),
    }


def test_read_feed_keeps_extra_columns_and_types(spark, scratch):
    path = _feeds(scratch)["package_requests"]
    df = read_feed(spark, "package_requests", path, partitions=2)
    assert df.columns[:5] == ["package_uuid", "client_type", "status", "request_addrs", "request_count"]
    assert "cache_misses" in df.columns
    assert dict(df.dtypes)["request_count"] == "bigint"
    assert df.where(F.col("client_type").isNull()).count() == 1


def test_update_job_end_to_end(spark, scratch):
    root = f"{scratch}/warehouse"
    reg = _csv(f"{scratch}/reg.csv", "package_uuid,package_name", ["u1,Foo", "u2,Bar"])
    out = run_update(spark, root, _feeds(f"{scratch}/in1"), [reg], partitions=2)
    assert set(out) == {"client_types", "packages", "requests_total", "requests_by_date", "requests_by_region_date", "systems_by_date", "versions_by_date", "requests_last_month"}
    pk = rows(read_table(spark, "packages", root))
    assert pk == [(1, "u1", "Foo"), (2, "u2", "Bar")]
    assert rows(read_table(spark, "requests_total", root)) == [(1, 1, 10), (1, 3, 2)]
    assert rows(read_table(spark, "systems_by_date", root)) == [("x86_64-linux", 1, D(2024, 3, 31), 7)]
    assert rows(read_table(spark, "versions_by_date", root)) == [("1.10", 1, D(2024, 3, 31), 4), ("1.9", 2, D(2024, 3, 31), 2)]
    assert rows(read_table(spark, "requests_last_month", root)) == [(1, 1, 10), (2, 2, 1)]
    # partitioned by date on disk
    assert os.path.isdir(f"{root}/requests_by_date/date=2024-03-31")

    # second run: a new registry entry and a trailing feed that only covers 03-31
    reg2 = _csv(f"{scratch}/reg2.csv", "package_uuid,package_name", ["u3,Baz", "u1,Renamed"])
    feeds2 = {
        "package_requests_by_date": _csv(
            f"{scratch}/in2/by_date.csv",
            "package_uuid,client_type,status,date,request_count",
            ["u1,user,200,2024-03-31,60", "u3,user,200,2024-04-01,7"],
        )
    }
    run_update(spark, root, feeds2, [reg2])
    assert rows(read_table(spark, "packages", root)) == [(1, "u1", "Foo"), (2, "u2", "Bar"), (3, "u3", "Baz")]
    by_date = rows(read_table(spark, "requests_by_date", root))
    # 03-31 partition rewritten: u1 replaced (60), u2's 03-31 row was not in the
    # new snapshot for that partition's keys -> kept; 03-30 untouched
    assert by_date == [
        (1, 1, D(2024, 3, 30), 4),
        (1, 1, D(2024, 3, 31), 60),
        (2, 2, D(2024, 3, 31), 1),
        (3, 1, D(2024, 4, 1), 7),
    ]
    # rerun of the same input changes nothing
    run_update(spark, root, feeds2, [reg2])
    assert rows(read_table(spark, "requests_by_date", root)) == by_date
    assert rows(read_table(spark, "requests_last_month", root)) == [(1, 1, 64), (2, 2, 1), (3, 1, 7)]


def _files(root):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(root) for n in names for f in [os.path.join(d, n)]}


def test_rerun_writes_only_changed_dates_and_leaves_no_staging(spark, scratch):
    spec, root = TABLES["requests_by_date"], f"{scratch}/wh"
    batch = [(1, 1, D(2024, 3, 29), 5), (2, 1, D(2024, 3, 29), 7), (1, 1, D(2024, 3, 30), 6)]
    merge_into_table(spark, spark.createDataFrame(batch, spec.schema), spec, root)
    before = _files(root)
    staging = f"{shared_dir(spark)}/staging/{spec.name}".removeprefix("file://")
    folders = set(os.listdir(staging)) if os.path.isdir(staging) else set()
    merge_into_table(spark, spark.createDataFrame(batch, spec.schema), spec, root)
    assert _files(root) == before
    merge_into_table(spark, spark.createDataFrame([*batch[:2], (1, 1, D(2024, 3, 30), 9)], spec.schema), spec, root)
    kept = {f for f in before if "date=2024-03-29" in f}
    assert kept and {f: t for f, t in _files(root).items() if f in kept} == {f: before[f] for f in kept}
    assert rows(read_table(spark, spec, root)) == [(1, 1, D(2024, 3, 29), 5), (1, 1, D(2024, 3, 30), 9), (2, 1, D(2024, 3, 29), 7)]
    assert set(os.listdir(staging)) <= folders


def test_quality_failure_leaves_table_untouched(spark, scratch):
    root = f"{scratch}/wh"
    spec = REQUESTS_BY_REGION_DATE
    good = spark.createDataFrame([(1, 1, "EU", D(2024, 1, 1), 1)], spec.schema)
    merge_into_table(spark, good, spec, root)
    bad = spark.createDataFrame([(1, 1, "MIDDLE EAST", D(2024, 1, 1), 5)], spec.schema)
    with pytest.raises(QualityError) as err:
        merge_into_table(spark, bad, spec, root)
    assert err.value.rows[0]["check_name"] == "max_length"
    assert rows(read_table(spark, spec, root)) == [(1, 1, "EU", D(2024, 1, 1), 1)]


def test_stream_two_snapshots_newest_wins(spark, scratch):
    src = f"{scratch}/incoming"
    header = "package_uuid,client_type,status,date,request_count"
    _csv(f"{src}/snap1/part-0.csv", header, ["u1,user,200,2024-03-31,5"])
    _csv(f"{src}/snap1/part-1.csv", header, ["u1,user,200,2024-03-30,1", "u1,user,200,2024-03-29,4"])
    _csv(f"{src}/snap1/part-2.csv", header, ["u1,user,200,2024-03-29,3"])
    time.sleep(1.1)
    for i, n in enumerate((1, 2, 5)):
        _csv(f"{src}/snap2/part-{i}.csv", header, [f"u1,user,200,2024-03-31,{n}"])
    pk = spark.createDataFrame([(1, "u1", "Foo")], TABLES["packages"].schema)
    from pkgpulse.sources.registry import client_types_frame

    ct = client_types_frame(spark)
    schema = "package_uuid string, client_type string, status int, date date, request_count int"
    run_snapshot_ingest(
        spark,
        source=src,
        source_format="csv",
        source_schema=schema_struct(spark, schema),
        to_feed=lambda b: b,
        transform=lambda feed, carry: ingest.ingest_requests_by_date(feed, pk, ct, carry=carry),
        spec=TABLES["requests_by_date"],
        table_root=f"{scratch}/tables",
        checkpoint=f"{scratch}/chk",
        options={"header": "true", "recursiveFileLookup": "true"},
    )
    got = rows(read_table(spark, "requests_by_date", f"{scratch}/tables"))
    assert got == [(1, 1, D(2024, 3, 29), 7), (1, 1, D(2024, 3, 30), 1), (1, 1, D(2024, 3, 31), 8)]
    # a later snapshot in a new micro-batch replaces again
    _csv(f"{src}/snap3/part-0.csv", header, ["u1,user,200,2024-03-31,9"])
    run_snapshot_ingest(
        spark,
        source=src,
        source_format="csv",
        source_schema=schema_struct(spark, schema),
        to_feed=lambda b: b,
        transform=lambda feed, carry: ingest.ingest_requests_by_date(feed, pk, ct, carry=carry),
        spec=TABLES["requests_by_date"],
        table_root=f"{scratch}/tables",
        checkpoint=f"{scratch}/chk",
        options={"header": "true", "recursiveFileLookup": "true"},
    )
    got = rows(read_table(spark, "requests_by_date", f"{scratch}/tables"))
    assert got == [(1, 1, D(2024, 3, 29), 7), (1, 1, D(2024, 3, 30), 1), (1, 1, D(2024, 3, 31), 9)]


def schema_struct(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_snapshot_cols_constant():
    assert SNAPSHOT_COLS == ("_snapshot",)


def test_late_part_of_a_snapshot_is_refused(spark, scratch):
    src, header = f"{scratch}/incoming", "julia_version_prefix,client_type,date,request_count"
    from pkgpulse.sources.registry import client_types_frame

    def load():
        run_snapshot_ingest(
            spark,
            source=src,
            source_format="csv",
            source_schema=schema_struct(spark, "julia_version_prefix string, client_type string, date date, request_count bigint"),
            to_feed=lambda b: b,
            transform=lambda feed, carry: ingest.ingest_versions_by_date(feed, client_types_frame(spark), carry=carry),
            spec=TABLES["versions_by_date"],
            table_root=f"{scratch}/tables",
            checkpoint=f"{scratch}/chk",
            options={"header": "true", "recursiveFileLookup": "true"},
        )

    _csv(f"{src}/s1/a.csv", header, ["1.9.1,user,2024-03-31,5", "1.9.2,user,2024-03-31,2"])
    _csv(f"{src}/s1/b.csv", header, ["1.9.3,user,2024-03-31,4"])
    load()
    want = [("1.9", 1, D(2024, 3, 31), 11)]
    assert rows(read_table(spark, "versions_by_date", f"{scratch}/tables")) == want
    _csv(f"{src}/s1/c.csv", header, ["1.9.1,user,2024-03-31,100"])
    with pytest.raises(Exception, match="came after the snapshot"):
        load()
    assert rows(read_table(spark, "versions_by_date", f"{scratch}/tables")) == want


def test_lost_dimension_stops_the_update(spark, scratch):
    root = f"{scratch}/wh"
    fact = spark.createDataFrame([(1, 1, 5)], TABLES["requests_total"].schema)
    merge_into_table(spark, fact, TABLES["requests_total"], root)
    registry = spark.createDataFrame([("u0", "New")], "package_uuid string, package_name string")
    with pytest.raises(RuntimeError, match="packages"):
        run_update(spark, root, {}, [registry])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, "packages", root)


def test_feed_with_another_header_order_fails(spark, scratch):
    _csv(f"{scratch}/f/a.csv", "julia_system,client_type,date,request_count", ["x86_64-linux-gnu,user,2024-01-01,1"])
    _csv(f"{scratch}/f/b.csv", "client_type,julia_system,date,request_count", ["user,x86_64-linux-gnu,2024-01-01,1"])
    with pytest.raises(Exception, match="header|Header"):
        read_feed(spark, "systems_by_date", f"{scratch}/f").collect()


def test_sums_beyond_32_bits(spark):
    from pkgpulse.sources.registry import client_types_frame

    feed = spark.createDataFrame([("u1", "user", 200, 1, 2_000_000_000)] * 2, "package_uuid string, client_type string, status int, request_addrs bigint, request_count bigint")
    pk = spark.createDataFrame([(1, "u1", "Foo")], TABLES["packages"].schema)
    assert rows(ingest.ingest_requests_total(feed, pk, client_types_frame(spark))) == [(1, 1, 4_000_000_000)]


def test_registry_csv_extracts_first_wins(spark, scratch):
    from pkgpulse.plans.dimensions import refresh_packages
    from pkgpulse.sources.registry import read_registries

    a = _csv(f"{scratch}/a.csv", "package_uuid,package_name", [" U1 ,FromA", "u2,Two"])
    b = _csv(f"{scratch}/b.csv", "package_uuid,package_name", ["u1,FromB", "u3,Three"])
    extract = read_registries(spark, [a, b])
    empty = spark.createDataFrame([], TABLES["packages"].schema)
    assert rows(refresh_packages(empty, extract)) == [(1, "u1", "FromA"), (2, "u2", "Two"), (3, "u3", "Three")]
