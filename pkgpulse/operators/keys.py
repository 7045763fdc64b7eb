"""Surrogate keys: dense ids for new natural keys, stable across runs.

Existing rows keep their ids; keys not yet in the dimension get
``max(id) + 1, max(id) + 2, ...`` in natural-key order. The numbering is the
DataFrame form of ``zipWithIndex``: range-partition and sort the new keys,
number rows inside each partition, and offset each partition by the row
counts of the partitions before it (one small aggregate: a row per
partition). No step funnels the new keys through one task. The numbered
frame is checkpointed to the shared folder first, so recomputation after an
executor loss cannot renumber rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgpulse.session import shared_dir

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row index here


def dense_index(df: DataFrame, order_col: str, start: int | Column = 1, id_col: str = "row_id") -> DataFrame:
    """Number rows ``start, start+1, ...`` in ``order_col`` order (unique values)."""
    spark = df.sparkSession
    shared_dir(spark)  # make sure a reliable checkpoint folder is set
    ranked = (
        df.repartitionByRange(order_col)
        .sortWithinPartitions(order_col)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)))
        .checkpoint(eager=True)
    )
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded frame, whole-frame window is fine here
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(id_col, (start_col + F.col("_offset") + F.col("_pos")).cast("int"))
        .drop("_part", "_pos", "_offset")
    )


def assign_surrogate_keys(
    existing: DataFrame,
    incoming: DataFrame,
    natural_key: str,
    id_col: str,
) -> DataFrame:
    """Incoming rows whose natural key is new, with fresh ids after ``max(id)``.

    ``incoming`` must hold one row per natural key."""
    new = incoming.join(existing.select(natural_key), natural_key, "left_anti")
    base = existing.select(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).scalar()
    return dense_index(new, natural_key, start=base + 1, id_col=id_col)
