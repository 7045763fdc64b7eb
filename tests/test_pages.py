"""Page builders over curated tables written by the update job."""

import pytest

from pkgpulse.plans import pages
from pkgpulse.plans.update import run_update
from pkgpulse.sources import testdata as T
from tests.conftest import SF001


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("wh"))
    feed = T.package_feed(spark, SF001)
    feeds = {
        "package_requests": feed,
        "package_requests_by_date": feed,
        "package_requests_by_region_by_date": feed,
        "systems_by_date": T.systems_feed(spark, SF001),
        "versions_by_date": T.versions_feed(spark, SF001),
    }
    registry = T.packages(spark, SF001).select("package_uuid", "package_name")
    run_update(spark, root, feeds, [registry], max_lengths={"region": 11})
    return root


@pytest.fixture(scope="module")
def tables(spark, warehouse):
    return pages.Tables.load(spark, warehouse)


def test_all_packages_page(tables):
    page = pages.all_packages_page(tables)
    k = page["kpis"].first()
    assert k.past_day_requests <= k.past_week_requests <= k.selected_timeframe_requests
    total = sum(r.total_requests for r in page["total_downloads"].collect())
    assert total == k.selected_timeframe_requests
    for name in ("version_share", "region_share", "system_share"):
        sums = page[name].groupBy("date").sum("proportion").collect()
        assert all(abs(r[1] - 1.0) < 1e-9 for r in sums)


def test_package_page_matches_all_when_summed(tables):
    page = pages.package_page(tables, "ALPHA")
    k = page["kpis"].first()
    daily = page["total_downloads"].collect()
    assert sum(r.total_requests for r in daily) == k.selected_timeframe_requests
    assert [r.date for r in daily] == sorted(r.date for r in daily)
    assert page["region_share"].count() == page["region_downloads"].count()


def test_top_page_display_names(tables):
    page = pages.top_page(tables)
    assert page["month"].columns == ["Package Name", "Total Requests"]
    assert page["trending"].columns == ["Package Name", "Percent Change"]
    names = [r["Package Name"] for r in page["month"].collect()]
    assert "Three_jll" in names  # _jll is only excluded from trending


def test_api_lookups(spark, tables):
    names = spark.createDataFrame([("pkg2",), ("Nope",)], "package_name string")
    api = pages.api_downloads(tables, names)
    got = {r.package_name: r.found for r in api["monthly_downloads"].collect()}
    assert got == {"pkg2": True, "Nope": False}


def test_region_name_over_limit_fails_the_load(spark, tmp_path_factory):
    from pkgpulse.plans.tables import QualityError
    from pkgpulse.sources.snapshots import table_exists

    root = str(tmp_path_factory.mktemp("wh2"))
    feed = T.package_feed(spark, SF001)
    registry = T.packages(spark, SF001).select("package_uuid", "package_name")
    with pytest.raises(QualityError) as err:
        run_update(spark, root, {"package_requests_by_region_by_date": feed}, [registry])
    assert {r["column_name"] for r in err.value.rows} == {"region"}
    assert not table_exists(spark, "requests_by_region_date", root)


def test_package_page_cleanses_the_name(tables):
    plain = pages.package_page(tables, "alpha")["total_downloads"].collect()
    dirty = pages.package_page(tables, "  al'pha%; ")["total_downloads"].collect()
    assert plain == dirty and len(plain) > 0
    raw = pages.package_page(tables, "  al'pha%; ", cleanse=False)["total_downloads"].count()
    assert raw == 0


def test_report_command_writes_each_report(spark, warehouse, tmp_path):
    import json as _json

    from pkgpulse.__main__ import parse_args, write_reports

    args = parse_args(["report", "--root", warehouse, "--page", "top", "--out", str(tmp_path), "--client-types", "1,2"])
    names = write_reports(spark, args)
    assert names == ["day", "month", "trending", "week"]
    month = [_json.loads(line) for f in (tmp_path / "top" / "month").glob("part-*.json") for line in f.read_text().splitlines()]
    assert month and {"package_name", "total_requests", "total_requests_fmt"} <= set(month[0])


def test_report_command_api_lookups(spark, warehouse, tmp_path):
    import json as _json

    from pkgpulse.__main__ import parse_args, write_reports

    names = tmp_path / "names.csv"
    names.write_text("package_name\nPKG2\nnope\n")
    args = parse_args(["report", "--root", warehouse, "--page", "api", "--names", str(names), "--out", str(tmp_path / "out")])
    assert write_reports(spark, args) == ["monthly_downloads", "total_downloads"]
    rows_ = [_json.loads(line) for f in (tmp_path / "out" / "api" / "monthly_downloads").glob("part-*.json") for line in f.read_text().splitlines()]
    by_name = {r["package_name"]: r for r in rows_}
    assert by_name["nope"]["json_v2"] == '{"package_name":"nope","total_requests":0}'
    assert by_name["PKG2"]["found"] is True
