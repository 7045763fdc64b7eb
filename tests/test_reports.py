"""Report builders on tiny hand-computed frames."""

import json

import pytest
from pyspark.sql import functions as F

from pkgpulse.plans import reports, summary
from tests.helpers import BY_DATE, D, PACKAGES, daily, rows

ASOF = D(2024, 3, 31)


def _pk(spark, names):
    return spark.createDataFrame([(i + 1, f"u{i + 1}", n) for i, n in enumerate(names)], PACKAGES)


def _trend_rows(pid, last_counts, prev_counts, ct=1):
    """prev: dates asof-27..asof-15 (13 dates) + shared day asof-14; last: asof-13..asof."""
    out = []
    prev_days = daily(D(2024, 3, 4), 13)  # 03-04 .. 03-16  (asof-27 .. asof-15)
    last_days = daily(D(2024, 3, 18), 14)  # 03-18 .. 03-31
    for d, c in zip(prev_days, prev_counts):
        out.append((pid, ct, d, c))
    for d, c in zip(last_days, last_counts):
        out.append((pid, ct, d, c))
    return out


def test_trending_periods_share_one_day(spark):
    shared = (1, 1, D(2024, 3, 17), 10)  # asof-14: counted in both periods
    data = _trend_rows(1, [20] * 14, [10] * 13) + [shared]
    data += _trend_rows(2, [20] * 14, [10] * 13)  # 13 prev rows only -> not > 12? 13 > 12 passes
    data += [(3, 1, d, 100) for d in daily(D(2024, 3, 4), 28)]  # name Foojll excluded
    fact = spark.createDataFrame(data, BY_DATE)
    pk = _pk(spark, ["Grow", "Other", "Foojll"])
    out = {r.package_name: (r.percent_change, r.percent_change_fmt) for r in reports.trending_packages(fact, pk).collect()}
    # Grow: last = 14*20 + 10 = 290, prev = 13*10 + 10 = 140 -> 107.142857.. -> 107.14
    assert out["Grow"] == (107.14, "107.14%")
    # Other: last = 280 (14 rows), prev = 130 (13 rows) -> 115.384.. -> 115.38
    assert out["Other"] == (115.38, "115.38%")
    assert "Foojll" not in out
    assert list(out) == ["Other", "Grow"]  # percent desc


def test_trending_thresholds(spark):
    few = [(1, 1, d, 50) for d in daily(D(2024, 3, 19), 13)]  # 12 last rows + ... -> 13 rows in last, none in prev
    low = _trend_rows(2, [5] * 14, [1] * 13)  # rows must exceed daily minimum 5
    shrink = _trend_rows(3, [10] * 14, [20] * 13)  # no growth
    # Two client types: 7 dates x 2 rows = 14 rows per period passes "> 12 rows"
    two = []
    for ct in (1, 2):
        two += [(4, ct, d, 30) for d in daily(D(2024, 3, 25), 7)]
        two += [(4, ct, d, 10) for d in daily(D(2024, 3, 4), 7)]
    fact = spark.createDataFrame(few + low + shrink + two + [(9, 1, ASOF, 1)], BY_DATE)
    pk = _pk(spark, ["Few", "Low", "Shrink", "TwoTypes", "x", "x", "x", "x", "Anchor"])
    assert rows(reports.trending_packages(fact, pk)) == []
    both = reports.trending_packages(fact, pk, client_types=(1, 2)).collect()
    assert [(r.package_name, r.percent_change) for r in both] == [("TwoTypes", 200.0)]


def test_trending_half_up_rounding(spark):
    # last 1001 / prev 1000 over the minimum rows -> 0.1% ; 0.125 -> 0.13 (half up)
    data = _trend_rows(1, [100] * 13 + [101], [100] * 13) + [(1, 1, D(2024, 3, 17), 100)]
    data += _trend_rows(2, [100] * 13 + [400], [100] * 13) + [(2, 1, D(2024, 3, 17), 100)]
    fact = spark.createDataFrame(data, BY_DATE)
    out = {r.package_name: r.percent_change for r in reports.trending_packages(fact, _pk(spark, ["A", "B"])).collect()}
    # A: last 1401+100=1501 vs prev 1300+100=1400 -> 7.214.. -> 7.21
    assert out["A"] == 7.21
    # B: last 1700+100=1800 vs 1400 -> 28.5714.. -> 28.57
    assert out["B"] == 28.57


def test_top_ties_by_name_and_case(spark):
    fact = spark.createDataFrame(
        [(1, 1, ASOF, 5), (2, 1, ASOF, 5), (3, 1, ASOF, 9), (4, 1, ASOF, 5), (3, 2, ASOF, 100), (1, 1, D(2024, 2, 1), 50)],
        BY_DATE,
    )
    pk = _pk(spark, ["b", "a", "Big", "a"])  # two packages named "a" merge
    top = reports.top_packages(fact, pk, "1 day", n=2).collect()
    assert [(r.package_name, r.total_requests, r.total_requests_fmt) for r in top] == [("a", 10, "10"), ("Big", 9, "9")]
    month = reports.top_packages(fact, pk, "1 month").collect()
    assert {r.package_name: r.total_requests for r in month}["b"] == 5  # 2024-02-01 is before asof - 1 month


def test_kpis_and_empty_windows(spark):
    data = [(1, 1, d, 1) for d in daily(D(2024, 3, 1), 31)] + [(2, 2, ASOF, 100)]
    fact = spark.createDataFrame(data, BY_DATE)
    k = reports.request_kpis(fact).first()
    assert (k.past_day_requests, k.past_week_requests, k.selected_timeframe_requests) == (1, 7, 30)
    assert k.past_week_requests_fmt == "7"
    none = reports.request_kpis(fact, client_types=()).first()
    assert (none.past_day_requests, none.past_week_requests, none.selected_timeframe_requests) == (0, 0, 0)
    pk = _pk(spark, ["Foo", "Bar", "Unused"])
    per = {r.package_key: r.selected_timeframe_requests for r in reports.request_kpis(fact, packages=pk, by_package=True).collect()}
    assert per == {"foo": 30, "bar": 0, "unused": 0}
    one = reports.request_kpis(fact, packages=pk, package_name="FOO").first()
    assert one.past_week_requests == 7
    alltime = reports.request_kpis(fact, timeframe="all", client_types=(1, 2)).first()
    assert alltime.selected_timeframe_requests == 131


def test_requests_by_orders_last_column_desc(spark):
    data = [(1, 1, d, 1) for d in daily(D(2024, 3, 29), 3)]
    fact = spark.createDataFrame(data, BY_DATE).withColumn("region", F.lit("EU"))
    out = reports.requests_by(fact, ["region", "date"]).collect()
    assert [r.date for r in out] == [D(2024, 3, 31), D(2024, 3, 30), D(2024, 3, 29)]
    asc = reports.package_daily(fact, _pk(spark, ["P"]), "p").collect()
    assert [r.date for r in asc] == [D(2024, 3, 29), D(2024, 3, 30), D(2024, 3, 31)]


def test_shares_sum_to_one(spark):
    data = [(1, 1, ASOF, 3, "EU"), (2, 1, ASOF, 1, "US"), (1, 1, D(2024, 3, 30), 2, "EU")]
    fact = spark.createDataFrame(data, "package_id int, client_type_id int, date date, request_count int, region string")
    share = reports.share_by(fact, "region")
    sums = {r.date: r.s for r in share.groupBy("date").agg(F.sum("proportion").alias("s")).collect()}
    assert all(abs(s - 1.0) < 1e-9 for s in sums.values())
    eu = share.where("region = 'EU' AND date = DATE'2024-03-31'").first()
    assert (eu.total_requests, eu.total_requests_day, eu.proportion) == (3, 4, 0.75)


@pytest.mark.parametrize(
    "build",
    [
        lambda f, p: reports.requests_by(f, ["date"]),
        lambda f, p: reports.top_packages(f, p),
        lambda f, p: reports.trending_packages(f, p),
        lambda f, p: reports.share_by(f.withColumn("region", F.lit("EU")), "region"),
        lambda f, p: reports.package_daily(f, p, "x"),
        lambda f, p: reports.systems_by(f.withColumn("system", F.lit("x86_64-linux")), "OS"),
        lambda f, p: summary.last_month_summary(f),
    ],
)
def test_empty_inputs(spark, build):
    fact = spark.createDataFrame([], BY_DATE)
    assert build(fact, _pk(spark, [])).count() == 0


def test_empty_input_kpis_are_zero(spark):
    k = reports.request_kpis(spark.createDataFrame([], BY_DATE)).first()
    assert (k.past_day_requests, k.past_week_requests, k.selected_timeframe_requests) == (0, 0, 0)


def test_lookup_json_shapes(spark):
    table = spark.createDataFrame(
        [(1, 1, 1234567), (2, 1, 5), (2, 2, 99)], "package_id int, client_type_id int, total_requests bigint"
    )
    pk = _pk(spark, ["Alpha", "alpha"])
    names = spark.createDataFrame([("ALPHA",), ("nope",)], "package_name string")
    got = {r.package_name: r for r in summary.lookup_downloads(summary.package_summary(table, pk), names).collect()}
    assert json.loads(got["ALPHA"].json_v1) == {"total_requests": "1,234,567"}  # lowest id wins
    assert json.loads(got["ALPHA"].json_v2) == {"total_requests": 1234567}
    assert got["nope"].json_v1 == '{"package_name":"nope","total_requests":0}'
    assert got["nope"].json_v2 == got["nope"].json_v1 and got["nope"].found is False


def test_summary_month_window(spark):
    data = [(1, 1, D(2024, 2, 29), 100), (1, 1, D(2024, 3, 1), 1), (1, 1, ASOF, 2)]
    out = summary.last_month_summary(spark.createDataFrame(data, BY_DATE)).collect()
    assert [(r.package_id, r.total_requests) for r in out] == [(1, 3)]  # 02-29 is the open lower bound


def test_trending_periods_are_parameters(spark):
    # disjoint 7-day periods: last = asof-6..asof, previous = asof-13..asof-7
    data = [(1, 1, d, 20) for d in daily(D(2024, 3, 25), 7)] + [(1, 1, d, 10) for d in daily(D(2024, 3, 18), 7)]
    fact = spark.createDataFrame(data, BY_DATE)
    out = reports.trending_packages(
        fact, _pk(spark, ["A"]), min_rows=6, last_period=(6, 0), previous_period=(13, 7)
    ).collect()
    assert [(r.package_name, r.percent_change) for r in out] == [("A", 100.0)]


REGION_FACT = "package_id int, client_type_id int, region string, date date, request_count int"


@pytest.mark.parametrize(
    "build",
    [
        lambda s, f, p: reports.package_share_by(f.withColumn("region", F.lit("EU")), p, "region"),
        lambda s, f, p: reports.package_requests_by(f.withColumn("region", F.lit("EU")), p, ["region", "date"], "x"),
        lambda s, f, p: reports.system_share(f.withColumn("system", F.lit("x86_64-linux"))),
        lambda s, f, p: reports.request_kpis(f, packages=p, by_package=True),
        lambda s, f, p: summary.package_summary(summary.last_month_summary(f), p),
        lambda s, f, p: summary.lookup_downloads(
            summary.package_summary(summary.last_month_summary(f), p), s.createDataFrame([], "package_name string")
        ),
        lambda s, f, p: summary.badges(p),
    ],
)
def test_more_empty_inputs(spark, build):
    fact = spark.createDataFrame([], BY_DATE)
    assert build(spark, fact, _pk(spark, [])).count() == 0


def test_empty_series_and_quality(spark):
    from pkgpulse.operators import quality
    from pkgpulse.operators.shares import as_series
    from pkgpulse.schemas import REQUESTS_BY_REGION_DATE

    empty = spark.createDataFrame([], REGION_FACT)
    assert as_series(empty.withColumn("total_requests", F.lit(1)), "region").count() == 0
    report = quality.violations(empty, REQUESTS_BY_REGION_DATE)
    assert report.count() > 0 and quality.failed(report).count() == 0


def test_trending_skips_zero_previous_total(spark):
    data = [(1, 1, d, 5) for d in daily(D(2024, 3, 18), 14)] + [(1, 1, d, 0) for d in daily(D(2024, 3, 4), 13)]
    fact = spark.createDataFrame(data, BY_DATE)
    out = reports.trending_packages(fact, _pk(spark, ["Z"]), daily_minimum=-1).collect()
    assert out == []


def test_single_series_points_are_date_ascending(spark):
    from pkgpulse.operators.shares import as_series

    data = [(1, 1, d, i) for i, d in enumerate(reversed(daily(D(2024, 3, 1), 5)))]
    totals = reports.requests_by(spark.createDataFrame(data, BY_DATE), ["date"], "all")
    series = as_series(totals, None).first().points
    assert [p.date for p in series] == daily(D(2024, 3, 1), 5)
    assert [p.total_requests for p in series] == [4, 3, 2, 1, 0]
