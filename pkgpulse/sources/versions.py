"""Versioned publish of unpartitioned tables: one pointer file, no table format.

The content of a table's version is written to a folder of its own,
``<table>/v=<n>-<id>``, and checked there; then ``<table>/_current`` is
replaced by a file that names the folder (written beside it and renamed over
it, which HDFS and local file systems do at once). Readers resolve the pointer
when they open the table. So a writer that stops anywhere leaves the old
version in place, and the content is written once. The previous version stays
for readers that have resolved it; older ones and those of stopped writers go
with the next publish.

A table without a pointer file is read as a plain folder of Parquet files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

POINTER = "_current"


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _located(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _located(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is absent."""
    where, fs = _located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to a path that does not exist yet."""
    (a, fs), (b, _) = _located(spark, source), _located(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at once: readers see the old or the new text."""
    target, fs = _located(spark, path)
    beside, _ = _located(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    qualified = fs.makeQualified(target)
    context = hadoop.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), qualified, how)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it is absent."""
    where, fs = _located(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str | None:
    """The folder name of the published version, or None."""
    return get_text(spark, f"{path}/{POINTER}")


def resolved(spark: SparkSession, path: str) -> str:
    """Where to read a table from: its published version, else the folder itself."""
    version = current(spark, path)
    return f"{path}/{version}" if version else path


def _number(version: str | None) -> int:
    return int(version.split("=")[1].split("-")[0]) if version else 0


def new_version(spark: SparkSession, path: str) -> str:
    """The folder name of a version to be written."""
    return f"v={_number(current(spark, path)) + 1:06d}-{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the one that readers see; all but it and its
    predecessor go."""
    before = current(spark, path)
    put_text(spark, f"{path}/{POINTER}", version)
    # one job writes a table at a time, so other folders are of older versions or stopped writers
    for name in names(spark, path):
        old = name.startswith("v=") and name not in (version, before)
        plain = before is None and name.startswith("part-")  # files of before the first publish
        if old or plain:
            delete(spark, f"{path}/{name}")
