"""Package registries (uuid -> name) and the static client-type dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgpulse.functions.client_types import CLIENT_TYPES
from pkgpulse.functions.text import canonical_uuid
from pkgpulse.schemas import CLIENT_TYPES as CLIENT_TYPES_SPEC


def client_types_frame(spark: SparkSession) -> DataFrame:
    """The 3-row client-type dimension (constant, so safe to broadcast).

    Built as an inline ``VALUES`` table: a local relation that the optimizer
    folds and broadcasts without running a job."""
    rows = ", ".join(f"('{name}', {cid})" for name, cid in CLIENT_TYPES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(client_type, client_type_id)").select(
        *[F.col(f.name).cast(f.dataType) for f in CLIENT_TYPES_SPEC.schema.fields]
    )


def union_registries(extracts: Sequence[DataFrame]) -> DataFrame:
    """All registries' (uuid, name) rows, tagged with the registry's position
    so that "first registry wins" can be applied later (``keep_first``)."""
    if not extracts:
        raise ValueError("at least one registry extract is needed")
    parts = [
        df.select(
            canonical_uuid("package_uuid").alias("package_uuid"),
            F.col("package_name").cast("string").alias("package_name"),
            F.lit(i).alias("registry_rank"),
        )
        for i, df in enumerate(extracts)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_registries(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Read registry extracts (``package_uuid``, ``package_name``), in order."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return union_registries([reader.format(fmt).load(p) for p in paths])
