"""What differs between two snapshots, row by row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns compared, lineage shown beside them, and what an inserted row shows.
COMPARED = ("fare_amount", "tip_amount")
LINEAGE = ("ingest_batch_id", "record_source", "ingested_at")
SHOWN = ("fare_amount", "tip_amount", "surcharge_fee", *LINEAGE)


def _need(key: str, *frames: DataFrame) -> None:
    if any(key not in f.columns for f in frames):
        raise ValueError(f"Both snapshots must contain {key}")


def changed_records(before: DataFrame, after: DataFrame, key: str = "trip_id", columns: Sequence[str] = COMPARED, value: str | None = None, limit: int | None = 1) -> DataFrame:
    """Rows of one key whose compared columns differ, null-safe, as before_ and after_ columns; of one key only if value is given."""
    _need(key, before, after)
    shared = set(before.columns) & set(after.columns)
    compared = [c for c in columns if c in shared]
    if not compared:
        raise ValueError("No comparison columns exist in both snapshots")
    b, a = before.alias("b"), after.alias("a")
    if value:  # on both sides, so that both scans can use it
        b, a = b.filter(F.col(f"b.{key}") == value), a.filter(F.col(f"a.{key}") == value)
    differs = reduce(Column.__or__, (~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in compared))
    pairs = [F.col(f"{side[0]}.{c}").alias(f"{side}_{c}") for c in [*compared, *(x for x in LINEAGE if x in shared)] for side in ("before", "after")]
    found = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).filter(differs).select(F.col(f"a.{key}").alias(key), *pairs)
    return found if limit is None else found.limit(limit)


def inserted_records(before: DataFrame, after: DataFrame, key: str = "trip_id", limit: int | None = 1) -> DataFrame:
    """Rows of after whose key before doesn't have."""
    _need(key, before, after)
    found = after.join(before.select(key), key, "left_anti").select(key, *(c for c in SHOWN if c in after.columns))
    return found if limit is None else found.limit(limit)


def key_exists(df: DataFrame, key: str, value: object) -> bool:
    """Whether a key occurs: a filter that stops at the first hit, no shuffle."""
    return not df.filter(F.col(key) == value).select(key).limit(1).isEmpty()
