"""Column functions: timeframes, client-type toggles, systems, text."""

import pytest
from pyspark.sql import functions as F

from pkgpulse.functions.client_types import client_type_ids, client_type_predicate
from pkgpulse.functions.systems import system_label, system_prefix, version_prefix
from pkgpulse.functions.text import badge_markdown, cleanse_name, percent_text, url_contains, with_thousands
from pkgpulse.functions.timeframes import Timeframe, parse_timeframe, trailing
from tests.helpers import D


def test_parse_timeframe():
    assert parse_timeframe("30d") == Timeframe(days=30)
    assert parse_timeframe("1 day") == Timeframe(days=1)
    assert parse_timeframe("1 week") == Timeframe(days=7)
    assert parse_timeframe("7 day") == Timeframe(days=7)
    assert parse_timeframe("1 month") == Timeframe(months=1)
    assert parse_timeframe("all") == Timeframe(months=1200)
    with pytest.raises(ValueError):
        parse_timeframe("soon")


def test_window_is_open_below_and_clamps_month_end(spark):
    df = spark.createDataFrame([(D(2024, 3, 31),)], "asof date")
    lows = df.select(
        parse_timeframe("1 month").lower_bound(F.col("asof")).alias("m"),
        parse_timeframe("7d").lower_bound(F.col("asof")).alias("w"),
    ).first()
    assert lows.m == D(2024, 2, 29)
    assert lows.w == D(2024, 3, 24)
    dates = spark.createDataFrame([(D(2024, 3, d),) for d in range(20, 32)], "date date")
    kept = dates.where(trailing("date", F.lit(D(2024, 3, 31)), "7d")).count()
    assert kept == 7  # exactly the last 7 calendar dates
    assert dates.where(trailing("date", F.lit(D(2024, 3, 31)), "1 day")).count() == 1


def test_client_type_toggles(spark):
    assert client_type_ids() == (1,)
    assert client_type_ids(True, True, True) == (1, 2, 3)
    assert client_type_ids(False, False, False) == ()
    df = spark.createDataFrame([(1,), (2,), (3,)], "client_type_id int")
    assert df.where(client_type_predicate(())).count() == 0  # none selected -> nothing
    assert df.where(client_type_predicate((2, 3))).count() == 2


def test_prefixes(spark):
    df = spark.createDataFrame([("x86_64-linux-gnu", "1.10.4"), ("aarch64", "1")], "s string, v string")
    out = df.select(system_prefix("s").alias("s"), version_prefix("v").alias("v")).collect()
    assert [tuple(r) for r in out] == [("x86_64-linux", "1.10"), ("aarch64", "1")]


@pytest.mark.parametrize(
    "system,full,arch,os",
    [
        ("x86_64-linux", "x86_64-linux", "x86_64", "linux"),
        ("aarch64-apple", "aarch64-macos", "aarch64", "macos"),
        ("x86_64-w64", "x86_64-windows", "x86_64", "windows"),
        ("x86_64-unknown", "x86_64-freebsd", "x86_64", "freebsd"),
        ("i686-linux", "i686-linux", "i686", "linux"),
        ("amd64-linux", "x86_64-linux", "x86_64", "linux"),
        ("arm64-apple", "aarch64-macos", "aarch64", "macos"),
        ("wasm32-emscripten", "wasm32-emscripten", "wasm32", "emscripten"),
        ("x86_64-pc", "x86_64-pc", "x86_64", "pc"),
        ("powerpc64le-linux", "powerpc64le-linux", "powerpc64le", "linux"),
    ],
)
def test_system_labels(spark, system, full, arch, os):
    df = spark.createDataFrame([(system,)], "system string")
    got = df.select(
        system_label("system", "Full"), system_label("system", "CPU Arch"), system_label("system", "OS")
    ).first()
    assert tuple(got) == (full, arch, os)


def test_system_label_rejects_unknown_mode():
    with pytest.raises(ValueError):
        system_label("system", "Kernel")


def test_cleanse_order_matters(spark):
    df = spark.createDataFrame([("  Data'Frames\";  ",), ("a-/-b",), ("x%y\\z",), ("\tpkg ",)], "s string")
    got = [r[0] for r in df.select(cleanse_name("s")).collect()]
    assert got == ["DataFrames", "a--b", "xyz", "pkg"]


def test_display_formats(spark):
    df = spark.createDataFrame([(1234567, 12.5), (0, 3.0)], "n bigint, p double")
    got = [tuple(r) for r in df.select(with_thousands("n"), percent_text("p")).collect()]
    assert got == [("1,234,567", "12.50%"), ("0", "3.00%")]


def test_badge_and_url_filter(spark):
    df = spark.createDataFrame([("Foo",)], "package_name string")
    badge = df.select(badge_markdown("package_name", site="https://s.example")).first()[0]
    assert badge.startswith("[![Downloads](https://img.shields.io/badge/dynamic/json?url=https%3A%2F%2Fs.example%2F")
    assert "monthly_downloads%2FFoo&query=total_requests" in badge
    assert badge.endswith("](https://s.example/pkg/Foo)")
    urls = spark.createDataFrame([("https://github.com/a/b",), ("https://gitlab.com/a",)], "url string")
    assert urls.where(url_contains("url")).count() == 1


def test_arch_and_os_helpers(spark):
    from pkgpulse.functions.systems import system_arch, system_os

    df = spark.createDataFrame([("arm64-apple",), ("i586-linux",), ("riscv64-linux",)], "system string")
    got = [tuple(r) for r in df.select(system_arch("system"), system_os("system")).collect()]
    assert got == [("aarch64", "macos"), ("i686", "linux"), ("riscv64", "linux")]


def test_timeframe_sql_literal(spark):
    assert parse_timeframe("30d").sql() == "INTERVAL '30' DAY"
    assert parse_timeframe("1 month").sql() == "INTERVAL '1' MONTH"
    row = spark.sql(f"SELECT DATE'2024-03-31' - {parse_timeframe('1 month').sql()} AS d").first()
    assert row.d == D(2024, 2, 29)
