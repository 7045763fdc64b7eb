"""Raw feed -> curated fact table, one function per feed.

Package feeds: keep successful requests (``status < 400``), label a null
client type ``missing`` (before grouping, so null and a literal ``missing``
end in one group), sum to the table's grain, map uuid -> package id (rows of
unregistered uuids drop out) and client type -> id (unknown types drop out).
System / version feeds: drop rows with a null in any column, truncate the
platform / version string, map the client type, and combine rows that now
share a key (``sum`` by default; ``last`` keeps the row latest in an explicit
order column; it equals a row-by-row upsert of the feed only if that column
is unique and follows the feed's row order).

Aggregation runs before the joins: the shuffle carries partial sums, and
hot keys are combined map-side. The dimension joins then see one row per
key. The planner broadcasts a dimension whose size estimate is under the
broadcast threshold and shuffle-joins it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.functions.systems import system_prefix, version_prefix
from pkgpulse.operators.upsert import keep_last
from pkgpulse.schemas import SYSTEM_FEED_COLUMN, VERSION_FEED_COLUMN

SUCCESS_BELOW = 400
NULL_FEED_VALUE = "package feed row with a null status or request_count"


def success_filter(strict: bool = True):
    """``status < 400``. Strict (the default): a row with a null status or
    count fails the job instead of being skipped, checked inside the same
    filter (no extra pass over the feed; the staged load stays untouched)."""
    keep = F.col("status") < SUCCESS_BELOW
    if not strict:
        return keep
    valid = F.col("status").isNotNull() & F.col("request_count").isNotNull()
    return F.when(valid, keep).otherwise(F.raise_error(F.lit(NULL_FEED_VALUE)))


def _package_counts(raw: DataFrame, grain: list[str], measures: dict[str, str], strict: bool = True) -> DataFrame:
    """``grain`` may include carried columns (e.g. a snapshot id)."""
    filled = raw.where(success_filter(strict)).withColumn(
        "client_type", F.coalesce(F.col("client_type"), F.lit("missing"))
    )
    sums = [F.sum(src).alias(dst) for dst, src in measures.items()]
    return filled.groupBy("package_uuid", "client_type", *grain).agg(*sums)


def _map_keys(agg: DataFrame, packages: DataFrame, client_types: DataFrame) -> DataFrame:
    pk = packages.select("package_uuid", "package_id")
    return agg.join(pk, "package_uuid").join(client_types, "client_type")


# ``carry``: extra columns kept as grouping keys and passed through (the
# streaming ingest carries the snapshot file of each row this way).


def ingest_requests_total(
    raw: DataFrame,
    packages: DataFrame,
    client_types: DataFrame,
    carry: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    measures = {"request_addrs": "request_addrs", "request_count": "request_count"}
    agg = _package_counts(raw, [*carry], measures, strict)
    out = _map_keys(agg, packages, client_types)
    return out.select("package_id", "client_type_id", "request_count", *carry)


def ingest_requests_by_date(
    raw: DataFrame,
    packages: DataFrame,
    client_types: DataFrame,
    carry: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    agg = _package_counts(raw, ["date", *carry], {"request_count": "request_count"}, strict)
    out = _map_keys(agg, packages, client_types)
    return out.select("package_id", "client_type_id", "date", "request_count", *carry)


def ingest_requests_by_region_date(
    raw: DataFrame,
    packages: DataFrame,
    client_types: DataFrame,
    carry: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    agg = _package_counts(raw, ["region", "date", *carry], {"request_count": "request_count"}, strict)
    out = _map_keys(agg, packages, client_types)
    return out.select("package_id", "client_type_id", "region", "date", "request_count", *carry)


def _truncated_feed(
    raw: DataFrame,
    client_types: DataFrame,
    key: str,
    prefix,
    combine: str,
    order_col: str | None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Combine to one row per truncated key before the client type is joined."""
    rows = raw.na.drop(how="any").withColumn(key, prefix)  # over every feed column, as read
    keys = [key, "client_type", "date", *carry]
    if combine == "sum":
        out = rows.groupBy(*keys).agg(F.sum("request_count").alias("request_count"))
    elif combine == "last":
        if not order_col:
            raise ValueError("combine='last' needs an explicit order column")
        out = keep_last(rows, keys, [order_col], ["request_count"])
    else:
        raise ValueError("combine must be 'sum' or 'last'")
    return out.join(client_types, "client_type").select(key, "client_type_id", "date", "request_count", *carry)


def ingest_systems_by_date(
    raw: DataFrame,
    client_types: DataFrame,
    combine: str = "sum",
    order_col: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    return _truncated_feed(raw, client_types, "system", system_prefix(SYSTEM_FEED_COLUMN), combine, order_col, carry)


def ingest_versions_by_date(
    raw: DataFrame,
    client_types: DataFrame,
    combine: str = "sum",
    order_col: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    return _truncated_feed(raw, client_types, "version", version_prefix(VERSION_FEED_COLUMN), combine, order_col, carry)
