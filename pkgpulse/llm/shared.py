"""Small Spark helpers used by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pkgpulse
from pkgpulse.session import shared_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once per application (what
    ``spark-submit --py-files`` does), so that tasks can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(pkgpulse.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pkgpulse-"), "pkgpulse.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


#: Spark's setting that removes a query's shuffle files when the query has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows that go to a Python worker at once
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the
    lineage, so that a lost executor never recomputes what came before. The
    shuffle files behind it are of no more use then, and go at once. ``batch``
    rows at most go to a Python worker at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    during = {_CLEANUP: "true"} | ({} if batch is None else {_BATCH: str(batch)})
    before = {key: spark.conf.get(key, None) for key in during}
    for key, value in during.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, at full length."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null stays null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % mod


def blocks(frames: Iterable[pd.DataFrame], column: str, limit: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Arrow batches cut into runs of rows holding about ``limit`` characters
    of ``column`` each, so that the arrays a task builds stay bounded by the
    run (or by the single longest text) and not by the batch."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy()
        run = (sizes.cumsum() // limit).astype("int64")
        if run[-1] == run[0]:
            yield frame
        else:
            for _, part in frame.groupby(run, sort=True):
                yield part
