"""Share of day and chart-ready series.

``with_daily_share`` first sums the input to (partition..., series), then
divides each row by its partition's total with a window sum. The window runs
on the aggregated rows, so one window partition holds one row per series
value of that date (a handful of versions / regions / systems), however many
raw rows the date had.

``as_series`` turns long rows into one row per series with its points sorted
by x (ascending). A series has one point per date of the report window, so
its size is bounded by the calendar, not by data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_daily_share(
    df: DataFrame,
    series_col: str,
    value_col: str = "total_requests",
    partition_cols: Sequence[str] = ("date",),
) -> DataFrame:
    """Columns: partition cols, series, value, ``{value}_day``, ``proportion``."""
    parts = list(partition_cols)
    summed = df.groupBy(*parts, series_col).agg(F.sum(value_col).alias(value_col))
    day_total = F.sum(value_col).over(Window.partitionBy(*parts))
    return summed.select(
        *parts,
        series_col,
        value_col,
        day_total.alias(f"{value_col}_day"),
        F.try_divide(F.col(value_col).cast("double"), day_total.cast("double")).alias("proportion"),
    )


def as_series(
    df: DataFrame,
    series_col: str | Sequence[str] | None,
    y_col: str = "total_requests",
    x_col: str = "date",
) -> DataFrame:
    """One row per series (one or several key columns, or None for a single
    series): ``points`` = sorted array of (x, y) structs. Rows are summed to
    one per series and x first, so a series is as long as its calendar."""
    keys = [] if series_col is None else [series_col] if isinstance(series_col, str) else list(series_col)
    summed = df.groupBy(*keys, x_col).agg(F.sum(y_col).alias(y_col))
    points = F.sort_array(F.collect_list(F.struct(F.col(x_col), F.col(y_col)))).alias("points")
    return summed.groupBy(*keys).agg(points)
