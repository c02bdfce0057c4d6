"""Paths of the tables, under SEDIMENTA_HOME or the folder above the package."""

from __future__ import annotations

import os
from pathlib import Path

HOME = Path(os.environ.get("SEDIMENTA_HOME", Path(__file__).resolve().parents[1] / "data"))
SOURCE_DIR = HOME / "source"
DIRTY_FIXTURE = HOME / "landing" / "dirty_test.parquet"
BRONZE, SILVER = HOME / "bronze" / "taxi_trips", HOME / "silver" / "taxi_trips"
REJECTED, BATCH_AUDIT = HOME / "silver" / "rejected_records", HOME / "silver" / "batch_audit"
GOLD = HOME / "gold" / "zone_hourly_metrics"
CHECKPOINT, EVIDENCE = HOME / "checkpoints" / "silver_taxi", HOME / "evidence"
#: Monthly files in the source folder, and the one that the dirty fixture is made from.
MONTHLY, FIXTURE_MONTH = "yellow_tripdata_*.parquet", "yellow_tripdata_2025-11.parquet"
