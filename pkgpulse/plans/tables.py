"""Writing curated tables: stage, check, then commit.

A load is all-or-nothing per table. Unpartitioned tables (dimensions, totals,
the monthly summary) are written once, to a version folder of their own,
checked there and then published by one pointer file (``sources.versions``).
Date-partitioned tables are staged under the shared folder, checked, and
rewritten only in the dates that changed (dynamic partition overwrite), so a
daily load of a multi-year table writes a few days. Either way the lineage
between reading the old table and writing the new one is cut.

Each commit records per date, in the table's ledger, the rows of the table and
the number and digest of the feed's rows. The next load compares its feed with
the ledger, without reading the table: a date whose feed rows are the same is
not merged, also when the table holds older keys that the feed lacks. Reports
take the as-of date from the ledger.

Within a date, files are sorted by ``package_id`` with a Bloom filter on it, so
that a report on one package skips nearly all row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from pkgpulse.operators.quality import failed, violations
from pkgpulse.operators.upsert import upsert, upsert_partitions
from pkgpulse.schemas import LEDGER, TableSpec
from pkgpulse.session import shared_dir
from pkgpulse.sources import versions
from pkgpulse.sources.snapshots import has_rows, ledger_path, read_ledger, read_table, table_path


class QualityError(RuntimeError):
    def __init__(self, table: str, rows: list):
        super().__init__(f"{table}: constraint violations {rows}")
        self.rows = rows


#: facts are looked up by package: their files are clustered by this column
CLUSTER = "package_id"


def _layout(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Output layout of a partitioned write: rebalance on the partition
    columns, so each date's rows go to few tasks (few files per date) while
    AQE splits a date that is too big for one task and merges small ones."""
    return df.hint("rebalance", *spec.partition_by) if spec.partition_by else df


def _clustered(df: DataFrame, spec: TableSpec) -> DataFrameWriter:
    """A writer of files that are sorted by package within each date, with a
    Bloom filter on the package, sized by what each row group holds."""
    dealt = _layout(df, spec)
    if CLUSTER not in spec.columns:
        return dealt.write
    writer = dealt.sortWithinPartitions(*spec.partition_by, CLUSTER).write
    return writer.option(f"parquet.bloom.filter.enabled#{CLUSTER}", "true").option(
        "parquet.bloom.filter.adaptive.enabled", "true"
    )


def stage(df: DataFrame, spec: TableSpec, spark: SparkSession | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh staging folder under the shared folder and read
    it back: the lineage is cut (a lost executor never recomputes the inputs)
    and the staged copy can be read several times at the cost of a scan."""
    spark = spark or df.sparkSession
    path = path or _staging_path(spark, spec)
    writer = _layout(df.select(*spec.columns), spec).write.mode("overwrite")
    if spec.partition_by:
        writer = writer.partitionBy(*spec.partition_by)
    writer.parquet(path)
    return spark.read.schema(spec.schema).parquet(path).select(*spec.columns)


def _staging_path(spark: SparkSession, spec: TableSpec) -> str:
    return f"{shared_dir(spark)}/staging/{spec.name}/{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession, spec: TableSpec) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stage`` for the length of one load: its folder goes when the load
    has ended, committed or refused."""
    top = _staging_path(spark, spec)
    try:
        yield lambda df: stage(df, spec, spark, f"{top}/{uuid.uuid4().hex}")
    finally:
        versions.delete(spark, top)


def _in(column: str, values: list) -> Column:
    """Membership of a list that may hold null (which a check then reports)."""
    known = [v for v in values if v is not None]
    return F.col(column).isin(known) if len(known) == len(values) else F.col(column).isin(known) | F.col(column).isNull()


def digests(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """(date, feed_rows, feed_digest) of a batch; a table without dates has
    one row with a null date. Keys are unique, so the xor of row hashes is a
    digest of the set of rows."""
    date = F.col(spec.partition_by[0]) if spec.partition_by else F.lit(None).cast("date")
    return rows.groupBy(date.alias("date")).agg(
        F.count(F.lit(1)).alias("feed_rows"), F.bit_xor(F.xxhash64(*spec.columns)).alias("feed_digest")
    )


def base_ledger(spark: SparkSession, target: DataFrame, spec: TableSpec, root: str) -> DataFrame:
    """The table's ledger; for a table written before there was one, the rows
    per date as they are stored, without a digest of the feed."""
    ledger = read_ledger(spark, spec, root)
    if ledger is not None or not spec.partition_by:
        return spark.createDataFrame([], LEDGER) if ledger is None else ledger
    counted = target.groupBy(F.col(spec.partition_by[0]).alias("date")).agg(F.count(F.lit(1)).alias("table_rows"))
    # counted at once, a row per date: the files go with the commit
    return spark.createDataFrame([(r["date"], r["table_rows"], None, None) for r in counted.collect()], LEDGER)


def changed_dates(batch: DataFrame, ledger: DataFrame, spec: TableSpec) -> list:
    """Dates whose feed rows differ from those of the last load that brought
    them, by number and digest: one value per date at most reaches the driver."""
    known = ledger.select("date", "feed_rows", "feed_digest")
    return [r[0] for r in digests(batch, spec).subtract(known).select("date").collect()]


def record(spark: SparkSession, merged: DataFrame, batch: DataFrame, ledger: DataFrame, spec: TableSpec, root: str) -> None:
    """Publish the table's ledger with what the dates of ``batch`` now hold."""
    date = F.col(spec.partition_by[0]) if spec.partition_by else F.lit(None).cast("date")
    counted = merged.groupBy(date.alias("d")).agg(F.count(F.lit(1)).alias("table_rows"))
    fed = digests(batch, spec).join(counted, F.col("date").eqNullSafe(F.col("d"))).select(*LEDGER.names)
    kept = ledger.join(fed.select(F.col("date").alias("d")), F.col("date").eqNullSafe(F.col("d")), "left_anti")
    path = ledger_path(root, spec)
    version = versions.new_version(spark, path)
    kept.unionByName(fed).coalesce(1).write.parquet(f"{path}/{version}")
    versions.publish(spark, path, version)


def check(staged: DataFrame, spec: TableSpec, dims: Mapping[str, DataFrame] | None = None) -> None:
    """Raise ``QualityError`` when any constraint of ``spec`` is violated."""
    bad = failed(violations(staged, spec, dims)).collect()  # at most a few rows per check
    if bad:
        raise QualityError(spec.name, [r.asDict() for r in bad])


def commit(staged: DataFrame, spec: TableSpec, root: str) -> None:
    """Overwrite the staged dates of a partitioned table."""
    writer = _clustered(staged, spec).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*spec.partition_by).parquet(table_path(root, spec))


@contextmanager
def new_content(spark: SparkSession, content: DataFrame, spec: TableSpec, root: str) -> Iterator[DataFrame]:
    """``content`` written as the next version of an unpartitioned table, to be
    checked; it is published when the block ends, and not if that fails."""
    path = table_path(root, spec)
    version = versions.new_version(spark, path)
    content.select(*spec.columns).write.parquet(f"{path}/{version}")
    yield spark.read.schema(spec.schema).parquet(f"{path}/{version}").select(*spec.columns)
    versions.publish(spark, path, version)


def merge_into_table(
    spark: SparkSession,
    incoming: DataFrame,
    spec: TableSpec,
    root: str,
    dims: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Upsert ``incoming`` into the table at ``root`` (replace by key, keep
    other keys), all-or-nothing. Returns the table.

    The batch is staged first (it is read several times below and may be an
    expensive ingest plan). Feeds carry their whole history: only the dates
    whose feed rows changed are merged and written."""
    with staging(spark, spec) as stage_here:
        batch = stage_here(incoming)
        target = read_table(spark, spec, root, absent_ok=True)
        ledger = base_ledger(spark, target, spec, root)
        changed = changed_dates(batch, ledger, spec)
        if not changed:
            return target
        if not spec.partition_by:
            with new_content(spark, upsert(target, batch, spec.keys), spec, root) as merged:
                check(merged, spec, dims)
            record(spark, merged, batch, ledger, spec, root)
        else:
            rows = merged = batch
            if has_rows(target):
                rows = batch.where(_in(spec.partition_by[0], changed))
                merged = stage_here(upsert_partitions(target, rows, spec.keys, spec.partition_by[0]))
            check(merged, spec, dims)
            commit(merged, spec, root)
            record(spark, merged, rows, ledger, spec, root)
    return read_table(spark, spec, root)


def replace_table(
    spark: SparkSession,
    content: DataFrame,
    spec: TableSpec,
    root: str,
    dims: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Replace a whole unpartitioned table (dimensions, the monthly summary)."""
    if spec.partition_by:
        raise ValueError(f"{spec.name} is partitioned: merge into it")
    with new_content(spark, content, spec, root) as written:
        check(written, spec, dims)
    return read_table(spark, spec, root)
