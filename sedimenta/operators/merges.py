"""The three merges of the silver layer."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.evolution import PROTECTED, auto_merge_enabled, schema_auto_merge
from sedimenta.operators.quality import RECENCY
from sedimenta.sources.versioned import VersionedTable

def newer(columns: tuple[str, ...]) -> str:
    """SQL for: s comes after t by the columns in order. A null decides nothing that an earlier column hasn't."""
    return reduce(lambda later, c: f"(s.{c} > t.{c} OR (s.{c} = t.{c} AND {later}))", columns[-2::-1], f"s.{columns[-1]} > t.{columns[-1]}")


#: Newer content replaces older; a later copy of the same content doesn't.
UPDATE_CONDITION = f"{newer(RECENCY)} AND NOT (s.business_hash <=> t.business_hash)"


def merge_silver(spark: SparkSession, updates: DataFrame, path: str | Path) -> int:
    """Upsert unique trips by trip_id; new columns are added to the table."""
    with schema_auto_merge(spark):
        return VersionedTable(spark, path).merge(updates, ["trip_id"], update_condition=UPDATE_CONDITION, evolve=auto_merge_enabled(spark), protected=PROTECTED)


def merge_rejected(spark: SparkSession, rejected: DataFrame, path: str | Path) -> int:
    """Insert rejected rows whose (batch, hash) the table doesn't hold, once each."""
    keys = ["ingest_batch_id", "raw_record_hash"]
    rows = rejected.withColumn("rejected_at", F.current_timestamp()).dropDuplicates(keys)
    with schema_auto_merge(spark):
        return VersionedTable(spark, path).merge(rows, keys, update=False, evolve=auto_merge_enabled(spark))


def upsert_audit(spark: SparkSession, audit: DataFrame, path: str | Path) -> int:
    """Insert or replace rows by batch_id."""
    return VersionedTable(spark, path).merge(audit, ["batch_id"])
