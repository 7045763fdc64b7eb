"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, SMJ -> BHJ when a side turns out small),
# a fixed session time zone (dates derived from timestamps must not move),
# and no UI server.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target size of coalesced shuffle partitions and of the files written
    # after a rebalance hint (the curated tables' files)
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # a malformed value fails the cast; it never becomes a null that a filter then drops
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "pkgpulse",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``shuffle_partitions`` should be sized so one partition of the largest
    shuffle fits comfortably in executor memory (~128-256 MB of shuffle data
    per partition); AQE coalesces it down for small inputs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, staging and stream state.

    Taken from ``spark.checkpoint.dir`` as configured for the cluster. Only a
    local-mode session without that setting (tests, benchmarks) gets a fresh
    temporary folder; a cluster session without it is an error, because a
    machine-local folder is not visible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no context
        sc = None
    if sc is None:
        if configured:
            return configured.rstrip("/")
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="pkgpulse-")
    sc.setCheckpointDir(local)
    return local
