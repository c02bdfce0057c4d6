"""Identity and content hashes. Their text forms are part of the data: changing one changes every key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Format of timestamps in keys, key columns in order, separator.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
ID_COLUMNS = ("VendorID", "PULocationID", "DOLocationID", "trip_distance")
DATE_COLUMNS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")
SEPARATOR = "||"
# Columns whose change makes a trip's content another one.
CDC_COLUMNS = (
    "fare_amount", "tip_amount", "total_amount", "extra", "mta_tax", "tolls_amount",
    "improvement_surcharge", "congestion_surcharge", "Airport_fee", "cbd_congestion_fee",
    "passenger_count", "payment_type", "surcharge_fee",
)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def trip_id() -> Column:
    """SHA-256 over the key columns and both dates; nulls and unreadable dates are empty, so positions stay apart."""
    dates = (F.date_format(F.try_to_timestamp(F.col(c).cast("string")), TIMESTAMP_FORMAT) for c in DATE_COLUMNS)
    return F.sha2(F.concat_ws(SEPARATOR, *(text_or_empty(F.col(c)) for c in ID_COLUMNS), *map(text_or_empty, dates)), 256)


def content_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of the columns as a JSON object, which leaves nulls out: an all-null column changes no hash."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns))), 256)


def add_trip_id(df: DataFrame) -> DataFrame:
    return df.withColumn("trip_id", trip_id())


def add_business_hash(df: DataFrame) -> DataFrame:
    """Hash of the content columns that df has; lineage and coordinates don't count."""
    return df.withColumn("business_hash", content_hash(c for c in CDC_COLUMNS if c in df.columns))
