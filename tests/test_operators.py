"""Ingest, upsert, surrogate keys, quality checks on tiny hand-made frames."""

from pyspark.sql import functions as F

from pkgpulse.operators import ingest, quality
from pkgpulse.operators.keys import assign_surrogate_keys, dense_index
from pkgpulse.operators.upsert import insert_absent, keep_first, keep_last, upsert, upsert_partitions
from pkgpulse.plans.dimensions import refresh_packages
from pkgpulse.schemas import REQUESTS_BY_DATE, REQUESTS_BY_REGION_DATE
from pkgpulse.sources.registry import client_types_frame
from tests.helpers import BY_DATE, D, PACKAGES, rows

FEED = "package_uuid string, client_type string, status int, region string, date date, request_addrs bigint, request_count int"


def _packages(spark):
    return spark.createDataFrame([(1, "u1", "Foo"), (2, "u2", "Bar")], PACKAGES)


def test_package_feed_cleaning(spark):
    raw = spark.createDataFrame(
        [
            ("u1", "user", 200, "EU", D(2024, 1, 1), 1, 5),
            ("u1", "user", 404, "EU", D(2024, 1, 1), 1, 7),  # status < 400 only
            ("u1", None, 200, "EU", D(2024, 1, 1), 1, 2),  # null -> missing
            ("u1", "missing", 200, "EU", D(2024, 1, 1), 1, 3),  # same group as null
            ("u9", "user", 200, "EU", D(2024, 1, 1), 1, 100),  # unregistered uuid
            ("u2", "bot", 200, "EU", D(2024, 1, 1), 1, 100),  # unknown client type
            ("u2", "ci", 200, "US", D(2024, 1, 2), 1, 4),
        ],
        FEED,
    )
    out = ingest.ingest_requests_by_date(raw, _packages(spark), client_types_frame(spark))
    assert rows(out) == [(1, 1, D(2024, 1, 1), 5), (1, 3, D(2024, 1, 1), 5), (2, 2, D(2024, 1, 2), 4)]
    total = ingest.ingest_requests_total(raw, _packages(spark), client_types_frame(spark))
    assert rows(total) == [(1, 1, 5), (1, 3, 5), (2, 2, 4)]
    assert dict(zip(out.columns, [f.dataType.simpleString() for f in out.schema])) == {
        "package_id": "int",
        "client_type_id": "int",
        "date": "date",
        "request_count": "bigint",
    }


def test_systems_feed_drops_null_rows_and_combines(spark):
    raw = spark.createDataFrame(
        [
            ("x86_64-linux-gnu", "user", D(2024, 1, 1), 3),
            ("x86_64-linux-musl", "user", D(2024, 1, 1), 4),
            ("x86_64-linux-gnu", None, D(2024, 1, 1), 50),  # any null -> dropped
            ("aarch64-apple-darwin", "ci", D(2024, 1, 1), 2),
        ],
        "julia_system string, client_type string, date date, request_count int",
    )
    ct = client_types_frame(spark)
    summed = ingest.ingest_systems_by_date(raw, ct)
    assert rows(summed) == [("aarch64-apple", 2, D(2024, 1, 1), 2), ("x86_64-linux", 1, D(2024, 1, 1), 7)]
    last = ingest.ingest_systems_by_date(raw, ct, combine="last", order_col="julia_system")
    assert rows(last) == [("aarch64-apple", 2, D(2024, 1, 1), 2), ("x86_64-linux", 1, D(2024, 1, 1), 4)]


def test_keep_first_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows(keep_first(df, ["k"], ["o"], ["v"])) == [("a", "x"), ("b", "z")]
    assert rows(keep_last(df, ["k"], ["o"], ["v"])) == [("a", "y"), ("b", "z")]


def test_upsert_replaces_and_keeps_stale(spark):
    target = spark.createDataFrame([(1, 1, D(2024, 1, 1), 10), (1, 1, D(2024, 1, 2), 20)], BY_DATE)
    batch = spark.createDataFrame([(1, 1, D(2024, 1, 2), 7), (1, 1, D(2024, 1, 3), 9)], BY_DATE)
    once = upsert(target, batch, REQUESTS_BY_DATE.keys)
    assert rows(once) == [(1, 1, D(2024, 1, 1), 10), (1, 1, D(2024, 1, 2), 7), (1, 1, D(2024, 1, 3), 9)]
    twice = upsert(once, batch, REQUESTS_BY_DATE.keys)
    assert rows(twice) == rows(once)  # idempotent: replaces, never adds
    touched = upsert_partitions(target, batch, REQUESTS_BY_DATE.keys, "date")
    assert rows(touched) == [(1, 1, D(2024, 1, 2), 7), (1, 1, D(2024, 1, 3), 9)]


def test_insert_absent_keeps_existing(spark):
    target = spark.createDataFrame([("u1", "Old")], "k string, v string")
    incoming = spark.createDataFrame([("u1", "New"), ("u2", "Two")], "k string, v string")
    assert rows(insert_absent(target, incoming, ["k"])) == [("u1", "Old"), ("u2", "Two")]


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(F.format_string("k%04d", F.col("id")).alias("k")).repartition(7)
    out = dense_index(df, "k", start=11, id_col="id")
    got = rows(out, "k", "id")
    assert [i for _, i in got] == list(range(11, 1011))


def test_surrogate_keys_and_registry_refresh(spark):
    existing = spark.createDataFrame([(1, "u1", "Foo"), (5, "u5", "Five")], PACKAGES)
    reg_a = spark.createDataFrame([("U1", "Renamed"), ("u3", "Three")], "package_uuid string, package_name string")
    reg_b = spark.createDataFrame([("u3", "Other"), ("u2", "Two")], "package_uuid string, package_name string")
    new = assign_surrogate_keys(existing, spark.createDataFrame([("u2",), ("u3",)], "package_uuid string"), "package_uuid", "package_id")
    assert rows(new, "package_uuid", "package_id") == [("u2", 6), ("u3", 7)]
    out = refresh_packages(existing, [reg_a, reg_b])
    assert rows(out) == [(1, "u1", "Foo"), (5, "u5", "Five"), (6, "u2", "Two"), (7, "u3", "Three")]
    renamed = refresh_packages(existing, [reg_a, reg_b], refresh_names=True)
    assert (1, "u1", "Renamed") in rows(renamed)
    empty = spark.createDataFrame([], PACKAGES)
    first = refresh_packages(empty, [reg_b])
    assert rows(first) == [(1, "u2", "Two"), (2, "u3", "Other")]


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "EUROPE", D(2024, 1, 1), 3),
            (1, 1, "EUROPE", D(2024, 1, 1), 4),  # duplicate key
            (9, 1, "MIDDLE EAST", D(2024, 1, 1), 1),  # unknown package, 11 chars
            (1, 2, "ASIA", None, 1),  # null date
        ],
        "package_id int, client_type_id int, region string, date date, request_count int",
    )
    dims = {"packages": _packages(spark), "client_types": client_types_frame(spark)}
    report = {
        (r.check_name, r.column_name): r.violations
        for r in quality.violations(df, REQUESTS_BY_REGION_DATE, dims).collect()
    }
    assert report[("unique", "package_id,client_type_id,region,date")] == 1
    assert report[("max_length", "region")] == 1
    assert report[("foreign_key", "package_id")] == 1
    assert report[("foreign_key", "client_type_id")] == 0
    assert report[("not_null", "date")] == 1
    assert report[("not_null", "request_count")] == 0
    assert quality.failed(quality.violations(df.where("package_id = 1 AND date IS NOT NULL").limit(1), REQUESTS_BY_REGION_DATE, dims)).count() == 0


def test_null_status_fails_the_feed_unless_lenient(spark):
    import pytest

    raw = spark.createDataFrame(
        [("u1", "user", 200, "EU", D(2024, 1, 1), 1, 5), ("u1", "user", None, "EU", D(2024, 1, 1), 1, 7)], FEED
    )
    strict = ingest.ingest_requests_by_date(raw, _packages(spark), client_types_frame(spark))
    with pytest.raises(Exception) as err:
        strict.collect()
    assert ingest.NULL_FEED_VALUE in str(err.value)
    lenient = ingest.ingest_requests_by_date(raw, _packages(spark), client_types_frame(spark), strict=False)
    assert rows(lenient) == [(1, 1, D(2024, 1, 1), 5)]
