"""Table definitions (schemas, keys, column limits, references).

The curated tables mirror the reference's relational model: two dimensions
(packages, client types), four daily fact tables, one all-time fact table and
one monthly summary. Spark enforces none of the constraints, so
``operators.quality`` checks them explicitly from these specs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, nullable=False) for name, dtype in cols])


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: StructType
    keys: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    max_lengths: dict[str, int] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    measure: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def limited(self, max_lengths: Mapping[str, int]) -> TableSpec:
        """The same table with other length limits, for the columns it has."""
        own = {c: n for c, n in max_lengths.items() if c in self.columns}
        return replace(self, max_lengths={**self.max_lengths, **own})


# Column length limits of the stored tables.
# package_uuid 36, package_name 100, client_type 20, region 10, system 17, version 4
PACKAGES = TableSpec(
    "packages",
    _schema(("package_id", IntegerType()), ("package_uuid", StringType()), ("package_name", StringType())),
    keys=("package_id",),
    unique=(("package_uuid",),),
    max_lengths={"package_uuid": 36, "package_name": 100},
)
CLIENT_TYPES = TableSpec(
    "client_types",
    _schema(("client_type", StringType()), ("client_type_id", IntegerType())),
    keys=("client_type_id",),
    unique=(("client_type",),),
    max_lengths={"client_type": 20},
)
_DIM_REFS = {"package_id": ("packages", "package_id"), "client_type_id": ("client_types", "client_type_id")}
_CT_REF = {"client_type_id": ("client_types", "client_type_id")}

REQUESTS_TOTAL = TableSpec(
    "requests_total",
    _schema(("package_id", IntegerType()), ("client_type_id", IntegerType()), ("request_count", LongType())),
    keys=("package_id", "client_type_id"),
    references=_DIM_REFS,
    measure="request_count",
)
REQUESTS_BY_DATE = TableSpec(
    "requests_by_date",
    _schema(
        ("package_id", IntegerType()),
        ("client_type_id", IntegerType()),
        ("date", DateType()),
        ("request_count", LongType()),
    ),
    keys=("package_id", "client_type_id", "date"),
    references=_DIM_REFS,
    partition_by=("date",),
    measure="request_count",
)
REQUESTS_BY_REGION_DATE = TableSpec(
    "requests_by_region_date",
    _schema(
        ("package_id", IntegerType()),
        ("client_type_id", IntegerType()),
        ("region", StringType()),
        ("date", DateType()),
        ("request_count", LongType()),
    ),
    keys=("package_id", "client_type_id", "region", "date"),
    max_lengths={"region": 10},
    references=_DIM_REFS,
    partition_by=("date",),
    measure="request_count",
)
SYSTEMS_BY_DATE = TableSpec(
    "systems_by_date",
    _schema(("system", StringType()), ("client_type_id", IntegerType()), ("date", DateType()), ("request_count", LongType())),
    keys=("system", "client_type_id", "date"),
    max_lengths={"system": 17},
    references=_CT_REF,
    partition_by=("date",),
    measure="request_count",
)
VERSIONS_BY_DATE = TableSpec(
    "versions_by_date",
    _schema(("version", StringType()), ("client_type_id", IntegerType()), ("date", DateType()), ("request_count", LongType())),
    keys=("version", "client_type_id", "date"),
    max_lengths={"version": 4},
    references=_CT_REF,
    partition_by=("date",),
    measure="request_count",
)
REQUESTS_LAST_MONTH = TableSpec(
    "requests_last_month",
    _schema(("package_id", IntegerType()), ("client_type_id", IntegerType()), ("total_requests", LongType())),
    keys=("package_id", "client_type_id"),
    references=_DIM_REFS,
    measure="total_requests",
)

TABLES: dict[str, TableSpec] = {
    t.name: t
    for t in (
        PACKAGES,
        CLIENT_TYPES,
        REQUESTS_TOTAL,
        REQUESTS_BY_DATE,
        REQUESTS_BY_REGION_DATE,
        SYSTEMS_BY_DATE,
        VERSIONS_BY_DATE,
        REQUESTS_LAST_MONTH,
    )
}

# What the commits of a fact table record per date of the feed (null: a table
# without dates): rows of the table, and rows and digest of the feed's rows.
LEDGER = StructType(
    [
        StructField("date", DateType()),
        StructField("table_rows", LongType()),
        StructField("feed_rows", LongType()),
        StructField("feed_digest", LongType()),
    ]
)

# Raw snapshot feeds (CSV with header). Only the columns the jobs use are
# typed; any further columns of a feed are kept as strings so a row with a
# null in any column can still be dropped where the job requires it.
# The column names of the published feeds; the platform and
# version feeds name their full-string columns as below.
SYSTEM_FEED_COLUMN = "julia_system"
VERSION_FEED_COLUMN = "julia_version_prefix"
RAW_FEEDS: dict[str, dict[str, str]] = {
    "package_requests": {
        "package_uuid": "string",
        "client_type": "string",
        "status": "int",
        "request_addrs": "bigint",
        "request_count": "bigint",
    },
    "package_requests_by_date": {
        "package_uuid": "string",
        "client_type": "string",
        "status": "int",
        "date": "date",
        "request_count": "bigint",
    },
    "package_requests_by_region_by_date": {
        "package_uuid": "string",
        "client_type": "string",
        "status": "int",
        "region": "string",
        "date": "date",
        "request_count": "bigint",
    },
    "systems_by_date": {
        SYSTEM_FEED_COLUMN: "string",
        "client_type": "string",
        "date": "date",
        "request_count": "bigint",
    },
    "versions_by_date": {
        VERSION_FEED_COLUMN: "string",
        "client_type": "string",
        "date": "date",
        "request_count": "bigint",
    },
    "registry": {"package_uuid": "string", "package_name": "string"},
}
