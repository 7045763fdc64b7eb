"""Raw snapshot feeds (CSV) and curated tables (Parquet).

Feeds are read with a header and every column as text (no schema inference
pass over the data), then the used columns are cast by name, so a feed may
carry extra or reordered columns. Casts run under ANSI mode: a malformed
value fails the job instead of silently becoming null, or, read by
``read_feed_checked``, goes to a table of rejected rows. Gzip files cannot be
split, so a feed is redistributed right after the read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgpulse.operators.asof import with_ledger
from pkgpulse.schemas import LEDGER, RAW_FEEDS, TABLES, TableSpec
from pkgpulse.sources import versions


#: column that ``read_feed`` adds on request: where in the feed a row stands
POSITION = "_position"


def _position() -> Column:
    """Place of a row in its feed, to be compared: files by path, blocks of a
    file by offset, and rows in the order in which their block is read."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _raw_feed(spark: SparkSession, feed: str, path: str | list[str], mode: str) -> DataFrame:
    """The feed as text, by the header of its files."""
    header = spark.read.option("header", True).csv(path).schema
    missing = [c for c in RAW_FEEDS[feed] if c not in header.names]
    if missing:
        raise ValueError(f"feed {feed!r} lacks columns {missing}")
    schema = header if mode == "FAILFAST" else header.add(_CORRUPT, "string")
    # enforceSchema off: a file whose header differs from the first one's fails the read
    checked = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return checked.option("mode", mode).option("columnNameOfCorruptRecord", _CORRUPT).csv(path)


def read_feed(
    spark: SparkSession,
    feed: str,
    path: str | list[str],
    partitions: int | None = None,
    position: bool = False,
) -> DataFrame:
    """Read one raw feed: typed used columns first, other columns as text.

    ``partitions`` redistributes rows right after the read. It only pays off
    for a few large unsplittable (gzip) files feeding heavy per-row work;
    the ingest's partial aggregation shuffles anyway, so the default is none.
    At scale prefer many files or a splittable codec. ``position`` adds the
    column ``POSITION``, by which rows can be put in feed order again."""
    types = RAW_FEEDS[feed]
    raw = _raw_feed(spark, feed, path, "FAILFAST")
    typed = [F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()]
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in types]
    df = raw.select(*typed, *extra, *([_position().alias(POSITION)] if position else []))
    if partitions:
        df = df.repartition(partitions)
    return df


_CORRUPT = "_corrupt_record"
# The largest number that the stored request counts hold.
LARGEST_COUNT = 2_147_483_647


def read_feed_checked(
    spark: SparkSession, feed: str, path: str | list[str], required: Sequence[str] = (), position: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): the rows of a feed that can be loaded, typed as by
    ``read_feed``, and one row per other row: feed, file, reason, record.

    Reasons, the first that holds: ``malformed`` (not the header's number of
    fields), ``cast:<column>`` (a value that is not of the column's type),
    ``null:<column>`` (for the ``required`` columns), ``range:<column>`` (a
    count below 0 or beyond the stored type). ``record`` is the row as JSON
    text, null fields left out; a malformed row is there as it stands."""
    types = RAW_FEEDS[feed]
    raw = _raw_feed(spark, feed, path, "PERMISSIVE")
    read = [c for c in raw.columns if c != _CORRUPT]
    typed = {c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()}
    reasons = [F.when(F.col(_CORRUPT).isNotNull(), F.lit("malformed"))]
    reasons += [F.when(F.col(f"`{c}`").isNotNull() & v.isNull(), F.lit(f"cast:{c}")) for c, v in typed.items()]
    reasons += [F.when(F.col(f"`{c}`").isNull(), F.lit(f"null:{c}")) for c in required]
    reasons += [
        F.when(~typed[c].between(0, LARGEST_COUNT), F.lit(f"range:{c}")) for c, t in types.items() if t == "bigint"
    ]
    judged = raw.withColumns({"_reason": F.coalesce(*reasons), "_file": F.col("_metadata.file_path"), POSITION: _position()})
    extra = [F.col(f"`{c}`") for c in read if c not in types]
    good = judged.where(F.col("_reason").isNull()).select(
        *[v.alias(c) for c, v in typed.items()], *extra, *([POSITION] if position else [])
    )
    record = F.when(F.col("_reason") == "malformed", F.col(_CORRUPT)).otherwise(F.to_json(F.struct(*[F.col(f"`{c}`") for c in read])))
    rejects = judged.where(F.col("_reason").isNotNull()).select(
        F.lit(feed).alias("feed"), F.col("_file").alias("file"), F.col("_reason").alias("reason"), record.alias("record")
    )
    return good, rejects


def stored_path(spark: SparkSession, spec: TableSpec, root: str) -> str:
    """Where the table's files are: the published version of an unpartitioned
    table, the table's folder (with a folder per date) of a partitioned one."""
    path = table_path(root, spec)
    return path if spec.partition_by else versions.resolved(spark, path)


def table_exists(spark: SparkSession, spec: TableSpec | str, root: str) -> bool:
    """Whether the table's folder is there; any other failure to read it is raised."""
    spec = TABLES[spec] if isinstance(spec, str) else spec
    try:
        spark.read.schema(spec.schema).parquet(stored_path(spark, spec, root))  # path listing only, no job
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_table(spark: SparkSession, spec: TableSpec | str, root: str, absent_ok: bool = False) -> DataFrame:
    """A curated table. One that does not exist is an error, or with
    ``absent_ok`` an empty frame with the table's schema. A table with a ledger
    of its dates takes its as-of date from there (``operators.asof``)."""
    spec = TABLES[spec] if isinstance(spec, str) else spec
    if absent_ok and not table_exists(spark, spec, root):
        return spark.createDataFrame([], spec.schema)
    rows = spark.read.schema(spec.schema).parquet(stored_path(spark, spec, root)).select(*spec.columns)
    if not spec.partition_by:
        return rows
    ledger = read_ledger(spark, spec, root)
    return rows if ledger is None else with_ledger(rows, ledger)


def ledger_path(root: str, spec: TableSpec) -> str:
    return f"{root.rstrip('/')}/_ledger/{spec.name}"


def read_ledger(spark: SparkSession, spec: TableSpec, root: str) -> DataFrame | None:
    """What the commits of a table recorded per date (null: the whole table):
    rows of the table, rows and digest of the feed; None before the first one."""
    path = ledger_path(root, spec)
    version = versions.current(spark, path)
    return spark.read.schema(LEDGER).parquet(f"{path}/{version}") if version else None


def create_if_missing(spark: SparkSession, spec: TableSpec, root: str) -> bool:
    """``CREATE TABLE IF NOT EXISTS``: write an empty table with the schema.
    Returns True when the table had to be created."""
    if table_exists(spark, spec, root):
        return False
    empty, path = spark.createDataFrame([], spec.schema), table_path(root, spec)
    if spec.partition_by:
        empty.write.mode("overwrite").partitionBy(*spec.partition_by).parquet(path)
    else:
        version = versions.new_version(spark, path)
        empty.write.parquet(f"{path}/{version}")
        versions.publish(spark, path, version)
    return True


def table_path(root: str, spec: TableSpec | str) -> str:
    name = spec if isinstance(spec, str) else spec.name
    return f"{root.rstrip('/')}/{name}"


def has_rows(df: DataFrame) -> bool:
    """True when ``df`` has at least one row (reads at most one row)."""
    return df.limit(1).count() > 0
