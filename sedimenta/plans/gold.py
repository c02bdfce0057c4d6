"""Gold: metrics of one pinned version of Silver."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import config
from sedimenta.operators.gold import build_gold
from sedimenta.sources.versioned import VersionedTable

LOG = logging.getLogger("sedimenta.gold")


def write_gold(gold: DataFrame, path: str | Path, silver_version: int) -> int:
    """Replace the table, schema included; groups are few, so one file."""
    stamped = gold.withColumns({"silver_version": F.lit(silver_version).cast("long"), "computed_at": F.current_timestamp()})
    return VersionedTable(gold.sparkSession, path).overwrite(stamped.coalesce(1), replace_schema=True)


def run_gold(spark: SparkSession, silver_path: str | Path = config.SILVER, gold_path: str | Path = config.GOLD, silver_version: int | None = None) -> dict:
    """Compute Gold from a version of Silver, the latest by default."""
    silver = VersionedTable(spark, silver_path)
    if not silver.exists():
        raise FileNotFoundError(f"Silver table not found: {silver_path}")
    version = silver.version() if silver_version is None else silver_version
    write_gold(build_gold(silver.read(version)), gold_path, version)
    kept = VersionedTable(spark, gold_path).read().agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trips")).first()
    total = sum(json.loads(a["stats"])["numRecords"] for a in silver.snapshot(version).files.values())
    summary = {"silver_version": version, "groups": kept["groups"], "rows_used": kept["trips"], "rows_total": total, "rows_filtered": total - kept["trips"]}
    LOG.info(json.dumps({"event": "gold", **summary}))
    return summary
