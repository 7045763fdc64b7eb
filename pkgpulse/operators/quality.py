"""Constraint checks for curated tables (Spark enforces none of them).

``violations(df, spec, dims)`` returns one row per check with the number of
offending rows (or duplicate key groups), zero included:

* ``not_null``    rows with a null in a column (every column is NOT NULL)
* ``max_length``  rows whose text is longer than the column limit
* ``unique``      key values that occur more than once (primary / unique keys)
* ``foreign_key`` rows whose reference is missing from the dimension

One pass per table does the primary-key check and carries every row-level
count along: rows are left-joined to each dimension's distinct keys (a small
side, broadcast by the planner when its estimate allows), grouped by the
primary key with partial aggregation (a hot duplicate key collapses
map-side), and a final global aggregate counts duplicate groups and sums the
row-level counts. Each further unique constraint is one more aggregation.
A load fails when any count is non-zero.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.schemas import TableSpec

RESULT_COLUMNS = ("table_name", "check_name", "column_name", "violations")


def _stack(table: str, counts: DataFrame, labels: list[tuple[str, str, str]]) -> DataFrame:
    """One-row frame of counts -> one row per (check, column)."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(check).alias("check_name"), F.lit(col).alias("column_name"), F.col(src).alias("violations"))
                for check, col, src in labels
            ]
        )
    ).alias("v")
    return counts.select(cells).select(
        F.lit(table).alias("table_name"),
        "v.check_name",
        "v.column_name",
        F.col("v.violations").cast("bigint").alias("violations"),
    )


def primary_pass(df: DataFrame, spec: TableSpec, dims: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Primary-key uniqueness plus all row-level checks, in one pass."""
    checked = df
    conds: list[tuple[str, str, F.Column]] = [("not_null", c, F.col(c).isNull()) for c in spec.columns]
    conds += [("max_length", c, F.length(c) > limit) for c, limit in spec.max_lengths.items()]
    for i, (column, (table, dim_col)) in enumerate(spec.references.items()):
        if not dims or table not in dims:
            continue
        known = dims[table].select(F.col(dim_col).alias(column)).distinct().withColumn(f"_known{i}", F.lit(True))
        checked = checked.join(known, column, "left")
        conds.append(("foreign_key", column, F.col(f"_known{i}").isNull()))
    per_key = checked.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(cond).alias(f"_c{i}") for i, (_, _, cond) in enumerate(conds)],
    )
    totals = per_key.agg(
        F.count_if(F.col("_rows") > 1).alias("_dup"),
        *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"_c{i}") for i in range(len(conds))],
    )
    labels = [(check, col, f"_c{i}") for i, (check, col, _) in enumerate(conds)]
    labels.insert(len(spec.columns) + len(spec.max_lengths), ("unique", ",".join(spec.keys), "_dup"))
    return _stack(spec.name, totals, labels)


def unique_check(df: DataFrame, spec: TableSpec, keys: tuple[str, ...]) -> DataFrame:
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    counts = dup.agg(F.count(F.lit(1)).alias("c"))
    return _stack(spec.name, counts, [("unique", ",".join(keys), "c")])


def violations(df: DataFrame, spec: TableSpec, dims: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All checks of ``spec`` on ``df``; ``dims`` maps table name -> frame."""
    out = primary_pass(df, spec, dims)
    for keys in spec.unique:
        out = out.unionByName(unique_check(df, spec, keys))
    return out.select(*RESULT_COLUMNS)


def failed(report: DataFrame) -> DataFrame:
    """Only the checks that found something."""
    return report.where(F.col("violations") > 0)
