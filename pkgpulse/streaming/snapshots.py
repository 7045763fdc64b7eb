"""Incremental snapshot ingest with Structured Streaming.

New snapshot files landing in a folder are picked up by a file stream; each
micro-batch is cleaned and aggregated like the batch ingest, then upserted
into the curated table (stage, check, dynamic partition overwrite). The
upsert replaces by key, so replaying a micro-batch after a failure gives the
same table (the checkpoint records which files were done).

A snapshot must be aggregated whole, and two snapshots of one feed must not
be added up. Every row is tagged with its snapshot: by default the folder of
its file, or any column of ``_metadata`` that the caller names. The ingest
carries that tag as an extra grouping key, so all part files of a snapshot are
summed; ``keep_last`` then keeps for each key the row of the newest snapshot
(that of the newest file, then by name).

Next to the checkpoint a ledger lists every file that came, by snapshot
(one small versioned table, ``sources.versions``).

* With a ``marker`` (e.g. ``_SUCCESS``) a snapshot counts only when its marker
  is there. A micro-batch only enters its files into the ledger; snapshots whose
  marker has come are then read whole from their listed files, in whichever
  micro-batches these came, and upserted. Unfinished ones wait. A part that
  comes after the marker makes its snapshot be read again. Snapshots newer than
  one that is read (again) are read with it, so that the newest still wins.
* Without a marker, what a micro-batch brings is taken for whole snapshots. A
  part that comes after its snapshot was ingested is refused with an error,
  because the snapshot would replace itself by a part.

The ledger is written after the tables: a replay finds the same files and
upserts the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pkgpulse.operators.upsert import keep_last
from pkgpulse.plans.tables import merge_into_table
from pkgpulse.schemas import TableSpec
from pkgpulse.sources import versions

SNAPSHOT_COLS = ("_snapshot",)
_FILES = "_snapshot string, path string, time timestamp, epoch long, done boolean"


def by_folder() -> Column:
    """The folder of a row's file."""
    return F.regexp_replace("_metadata.file_path", "/[^/]*$", "")


def tag_snapshot(df: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """Add the snapshot and the source file's modification time to every row."""
    return df.select(
        "*",
        (by_folder() if snapshot is None else snapshot).cast("string").alias("_snapshot"),
        F.col("_metadata.file_modification_time").alias("_snapshot_time"),
    )


def newest_per_key(rows: DataFrame, spec: TableSpec, snapshots: DataFrame) -> DataFrame:
    """One row per table key: the one from the newest snapshot. ``snapshots``
    is (_snapshot, _snapshot_time), one row each."""
    values = [c for c in spec.columns if c not in spec.keys]
    dated = rows.join(snapshots, "_snapshot")
    return keep_last(dated, list(spec.keys), ["_snapshot_time", "_snapshot"], values).select(*spec.columns)


class _Ledger:
    """The files that came so far and whether their snapshot was ingested."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place
        version = versions.current(spark, place)
        self.files = spark.read.schema(_FILES).parquet(f"{place}/{version}") if version else spark.createDataFrame([], _FILES)

    def publish(self, files: DataFrame) -> None:
        version = versions.new_version(self.spark, self.place)
        files.coalesce(1).write.parquet(f"{self.place}/{version}")
        versions.publish(self.spark, self.place, version)
        self.files = self.spark.read.schema(_FILES).parquet(f"{self.place}/{version}")

    def enter(self, arrived: DataFrame, epoch: int, done: bool) -> None:
        """Add the files that are not listed yet."""
        new = arrived.select("_snapshot", "path", "time", F.lit(epoch).cast("long").alias("epoch"), F.lit(done).alias("done"))
        self.publish(self.files.unionByName(new.join(self.files.select("path"), "path", "left_anti")))

    def refuse_parts(self, arrived: DataFrame, epoch: int) -> None:
        earlier = self.files.where(F.col("epoch") != epoch).select("_snapshot").distinct()
        again = arrived.select("_snapshot").distinct().join(earlier, "_snapshot", "left_semi").take(5)
        if again:
            raise RuntimeError(f"files of {[r[0] for r in again]} came after the snapshot was ingested; load it whole")

    def ready(self, marker: Callable[[str], str]) -> list[str]:
        """Snapshots to be read now: those with new files and a marker, and all
        ingested ones that are newer than the oldest of them."""
        by_snapshot = self.files.groupBy("_snapshot").agg(F.max("time").alias("time"), F.bool_and("done").alias("done"))
        waiting = by_snapshot.where("not done").collect()  # a row per unfinished snapshot
        whole = [(r["time"], r["_snapshot"]) for r in waiting if versions.exists(self.spark, marker(r["_snapshot"]))]
        if not whole:
            return []
        time, name = min(whole)
        newer = by_snapshot.where("done").where(
            (F.col("time") > F.lit(time)) | ((F.col("time") == F.lit(time)) & (F.col("_snapshot") > name))
        )
        return [s for _, s in whole] + [r["_snapshot"] for r in newer.collect()]

    def paths(self, snapshots: list[str]) -> list[str]:
        return [r["path"] for r in self.files.where(F.col("_snapshot").isin(snapshots)).select("path").collect()]

    def finish(self, snapshots: list[str]) -> None:
        self.publish(self.files.withColumn("done", F.col("done") | F.col("_snapshot").isin(snapshots)))


def run_snapshot_ingest(
    spark: SparkSession,
    source: str,
    source_format: str,
    source_schema: StructType,
    to_feed: Callable[[DataFrame], DataFrame],
    transform: Callable[[DataFrame, Sequence[str]], DataFrame],
    spec: TableSpec,
    table_root: str,
    checkpoint: str,
    options: dict[str, str] | None = None,
    await_termination: bool = True,
    trigger: dict | None = None,
    snapshot: Column | None = None,
    dims: Mapping[str, DataFrame] | None = None,
    marker: str | Callable[[str], str] | None = None,
):
    """Start (and by default finish) the ingest stream.

    ``to_feed(batch)`` maps stream rows to feed rows and must keep the
    ``SNAPSHOT_COLS``; ``transform(feed, carry)`` is the batch ingest, carrying
    those columns as extra keys; ``snapshot`` names a row's snapshot (default:
    its file's folder); ``dims`` are checked as foreign keys; ``marker`` is the
    name of the file that completes a snapshot's folder, or a function from a
    snapshot to the marker's path. ``trigger`` defaults to
    ``{"availableNow": True}`` (process what is there, then stop); pass e.g.
    ``{"processingTime": "1 hour"}`` with ``await_termination=False`` to keep
    watching the folder."""
    reader = spark.readStream.format(source_format).schema(source_schema)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    stream = tag_snapshot(reader.load(source), snapshot).withColumn("_path", F.col("_metadata.file_path"))
    place = f"{checkpoint.rstrip('/')}-ledger"
    at = marker if callable(marker) else (lambda s: f"{s}/{marker}")

    def ingest(own: SparkSession, rows: DataFrame) -> None:
        snapshots = rows.groupBy("_snapshot").agg(F.max("_snapshot_time").alias("_snapshot_time"))
        feed = to_feed(rows.drop("_snapshot_time"))
        merge_into_table(own, newest_per_key(transform(feed, SNAPSHOT_COLS), spec, snapshots), spec, table_root, dims)

    def settle(own: SparkSession, ledger: _Ledger) -> None:
        """Ingest the waiting snapshots whose marker has come."""
        ready = ledger.ready(at)
        if ready:
            again = own.read.format(source_format).schema(source_schema)
            for key, value in (options or {}).items():
                if key not in ("recursiveFileLookup", "pathGlobFilter"):  # the files are named here
                    again = again.option(key, value)
            ingest(own, tag_snapshot(again.load(ledger.paths(ready)), snapshot))
            ledger.finish(ready)

    def process(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        ledger = _Ledger(own, place)
        arrived = batch.groupBy("_snapshot", F.col("_path").alias("path")).agg(F.max("_snapshot_time").alias("time"))
        if marker is None:
            ledger.refuse_parts(arrived, epoch_id)
            ingest(own, batch.drop("_path"))
            ledger.enter(arrived, epoch_id, done=True)
        else:
            ledger.enter(arrived, epoch_id, done=False)
            settle(own, ledger)

    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    if await_termination:
        query.awaitTermination()
        if marker is not None:  # a marker may come alone, without a file that starts a micro-batch
            settle(spark, _Ledger(spark, place))
    return query
