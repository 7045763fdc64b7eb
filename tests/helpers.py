import datetime as dt

from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

D = dt.date

BY_DATE = StructType(
    [
        StructField("package_id", IntegerType()),
        StructField("client_type_id", IntegerType()),
        StructField("date", DateType()),
        StructField("request_count", LongType()),
    ]
)
PACKAGES = StructType(
    [
        StructField("package_id", IntegerType()),
        StructField("package_uuid", StringType()),
        StructField("package_name", StringType()),
    ]
)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def daily(start: dt.date, n: int):
    return [start + dt.timedelta(days=i) for i in range(n)]
