"""Dimension maintenance: the package table from registry extracts.

Registries are unioned in order; a uuid listed by several registries takes
the first registry's name. Uuids already in the table keep their id and
name (insert-if-absent); new uuids get ids after the current maximum, in
uuid order. With ``refresh_names`` existing rows take the registry's current
name instead (ids never change).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgpulse.operators.keys import assign_surrogate_keys
from pkgpulse.operators.upsert import insert_absent, keep_first
from pkgpulse.sources.registry import union_registries


def first_names(extracts: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """One (uuid, name) per uuid: the first registry's entry."""
    registry = extracts if isinstance(extracts, DataFrame) else union_registries(extracts)
    return keep_first(registry, ["package_uuid"], ["registry_rank"], ["package_name"])


def new_packages(existing: DataFrame, extracts: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """Registry uuids the table does not have yet."""
    return first_names(extracts).join(existing.select("package_uuid"), "package_uuid", "left_anti")


def refresh_packages(
    existing: DataFrame,
    extracts: Sequence[DataFrame] | DataFrame,
    refresh_names: bool = False,
) -> DataFrame:
    """New content of the package table (``package_id, package_uuid, package_name``)."""
    first = first_names(extracts)
    new = assign_surrogate_keys(existing, first, "package_uuid", "package_id")
    out = insert_absent(existing, new.select("package_id", "package_uuid", "package_name"), ["package_uuid"])
    if refresh_names:
        renamed = out.alias("o").join(first.alias("f"), "package_uuid", "left")
        out = renamed.select(
            "package_id", "package_uuid", F.coalesce(F.col("f.package_name"), F.col("o.package_name")).alias("package_name")
        )
    return out


def name_history(extracts: DataFrame) -> DataFrame:
    """Validity intervals of package names from successive registry extracts.

    ``extracts`` holds (extract_date, package_uuid, package_name), every date
    one whole extract. One row per stretch of successive extracts that list a
    uuid under one name: ``valid_from`` (its first extract), ``last_listed``, and
    ``valid_to``, the first extract that no longer does (null: it still holds).
    A uuid that goes and comes back has a gap; of several names in one extract
    the first by text counts. The package table itself keeps the first name."""
    listed = extracts.groupBy("package_uuid", "extract_date").agg(F.min("package_name").alias("package_name"))
    # the extracts in order: one row per date, so one task numbers them
    dates = extracts.select("extract_date").distinct()
    by_date = Window.orderBy("extract_date")
    numbered = dates.select(
        "extract_date",
        F.row_number().over(by_date).alias("nth"),
        F.lead("extract_date").over(by_date).alias("next_date"),
    )
    # of one name, the extract's number less the row's stays the same along a stretch
    of_name = Window.partitionBy("package_uuid", "package_name").orderBy("nth")
    rows = listed.join(numbered, "extract_date").withColumn("stretch", F.col("nth") - F.row_number().over(of_name))
    return rows.groupBy("package_uuid", "package_name", "stretch").agg(
        F.min("extract_date").alias("valid_from"),
        F.max("extract_date").alias("last_listed"),
        F.max_by("next_date", "nth").alias("valid_to"),
    ).drop("stretch")
