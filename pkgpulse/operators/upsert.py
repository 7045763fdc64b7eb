"""Insert-if-absent, upsert and in-batch de-duplication as DataFrame algebra.

Plain Parquet has no ``MERGE``; the recipes here compute the merged rows and
``plans.tables`` writes them (stage, check, then dynamic partition overwrite).

* ``insert_absent``: existing rows win; only keys new to the target are added
  (``ON CONFLICT DO NOTHING``). Names of existing uuids therefore never change.
* ``upsert``: incoming rows replace target rows with the same key, never add
  to them; target keys absent from the batch are kept (``DO UPDATE SET``).
* ``keep_first`` / ``keep_last``: one row per key by an explicit order.

De-duplication is a hash aggregate with ``min_by`` / ``max_by`` over a struct,
not a window: partial aggregation collapses a hot key map-side, so a key that
holds a third of the batch never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None, fn) -> DataFrame:
    keys = list(keys)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    if not cols:
        return df.select(*keys).distinct()
    picked = fn(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one smallest in ``order`` (first occurrence)."""
    return _pick(df, keys, order, cols, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one largest in ``order`` (last occurrence wins)."""
    return _pick(df, keys, order, cols, F.max_by)


def insert_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the incoming rows whose key the target lacks.

    ``incoming`` must already hold one row per key (see ``keep_first``)."""
    keys = list(keys)
    new = incoming.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace same-key target rows; other target rows stay."""
    keys = list(keys)
    kept = target.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming.select(*target.columns))


def upsert_partitions(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], partition_col: str
) -> DataFrame:
    """``upsert`` restricted to the partitions the batch touches.

    The result is exactly the new content of those partitions, ready for a
    dynamic partition overwrite. The target is first limited to the batch's
    ``[min, max]`` partition range with scalar subqueries, which on a
    partitioned table become partition filters (untouched dates are never
    listed or read); the semi-join then keeps exactly the touched values.
    ``incoming`` is read several times, so pass a materialized (staged) batch."""
    col = F.col(partition_col)
    lo = incoming.select(F.min(partition_col)).scalar()
    hi = incoming.select(F.max(partition_col)).scalar()
    touched = incoming.select(partition_col).distinct()
    in_touched = target.where(col.between(lo, hi)).join(touched, partition_col, "left_semi")
    return upsert(in_touched, incoming, keys)
