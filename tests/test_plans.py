"""Physical-plan properties: pruning, no Python in the hot path, no cartesians."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from pkgpulse.plans import reports
from pkgpulse.plans.tables import stage
from pkgpulse.schemas import REQUESTS_BY_DATE
from pkgpulse.sources import testdata as T
from tests.conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def partitioned(spark):
    """The fixture by-date table written the production way (date partitions)."""
    return stage(T.requests_by_date(spark, SF001), REQUESTS_BY_DATE, spark)


def scans(text: str) -> list[str]:
    """Detail blocks of the plan's parquet scans."""
    blocks = text.split("\n\n")
    return [b for b in blocks if "Scan parquet" in b and "Location:" in b]


def test_window_becomes_partition_filter(spark, partitioned):
    text = plan(reports.top_packages(partitioned, T.packages(spark, SF001), "7 day"))
    fact = [b for b in scans(text) if "staging/requests_by_date" in b]
    main = [b for b in fact if "PartitionFilters" in b][0]
    assert "(date#" in main and "Subquery subquery" in main.split("PartitionFilters")[1].split("\n")[0]
    assert "EqualTo(client_type_id,1)" in main  # client-type toggle pushed to Parquet
    # the as-of subquery reads no data columns
    assert any("ReadSchema: struct<>" in b for b in fact)
    assert "TakeOrderedAndProject" in text


def test_trending_is_one_scan_no_self_join(spark, partitioned):
    text = plan(reports.trending_packages(partitioned, T.packages(spark, SF001)))
    main = text.split("===== Subqueries =====")[0]
    fact_scans = [b for b in scans(main) if "staging/requests_by_date" in b]
    assert len(fact_scans) == 1  # both periods from one scan
    assert "SortMergeJoin" not in main


def test_column_pruning_reaches_scan(spark, partitioned):
    text = plan(reports.requests_by(partitioned, ["date"]))
    assert "ReadSchema: struct<client_type_id:int,request_count:bigint>" in text


OWN = set(E.queries()) - set(E.llm.queries() if E.llm else ())


@pytest.mark.parametrize("name", sorted(OWN - {"stream_ingest"}))
def test_registered_plans_stay_in_jvm(spark, name):
    text = plan(E.queries()[name](spark, SF001))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in text, f"{name}: {node}"
    assert "CartesianProduct" not in text, name
    assert "BroadcastNestedLoopJoin" not in text, name


def test_upsert_reads_only_the_batch_date_range(spark, partitioned):
    from pyspark.sql import functions as F

    from pkgpulse.operators.upsert import upsert_partitions

    batch = stage(
        partitioned.where(F.col("date") >= F.lit("2024-01-25").cast("date")).withColumn("request_count", F.col("request_count") + 1),
        REQUESTS_BY_DATE,
        spark,
    )
    merged = upsert_partitions(partitioned, batch, REQUESTS_BY_DATE.keys, "date")
    text = plan(merged)
    target_scans = [b for b in scans(text) if "PartitionFilters" in b and ".min(date)" in b]
    assert target_scans and ".max(date)" in target_scans[0]
    assert merged.count() == partitioned.where(F.col("date") >= F.lit("2024-01-25").cast("date")).count()
